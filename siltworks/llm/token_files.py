"""Token files: Parquet with a list column of token ids. Ids are dictionary encoded, ids of documents and
lengths delta encoded; row groups are bounded by tokens and pages have an index, so a reader takes single
columns, or the row groups and pages of some documents, without the rest."""

from __future__ import annotations

import json
import re
import zlib
from itertools import compress, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Published, open_fs, shared_path

#: Pieces and parts of texts that a worker remembers the ids of.
REMEMBERED = 800_000
#: How a tokenizer whose parts are remembered cuts texts.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for lower-case ASCII.
PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+").findall
#: Tokens in a row group, at most one document more.
GROUP_TOKENS = 1 << 20
FILE = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("tokens", pa.list_(pa.int32()))])
MANIFEST = "file int, path string, n_docs long, n_tokens long"
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def cuts_at_blanks(model: str) -> bool:
    """Whether a tokenizer, given as its JSON, is known to lower-case, to cut at white space and between letters and other signs, and to mark
    the ends of words, and adds no tokens but those named <|...|>. Of others nothing is assumed."""
    x = json.loads(model)
    norm, pre = x.get("normalizer") or {}, x.get("pre_tokenizer") or {}
    norms, pres = norm.get("normalizers", [norm]), pre.get("pretokenizers", [pre])
    first = pres[0] if pres else {}
    return (
        [n.get("type") for n in norms] == ["NFC", "Replace", "Lowercase"] and norms[1].get("pattern") == {"Regex": r"\s+"} and norms[1].get("content") == " "
        and [n.get("type") for n in pres] == ["Split", "ByteLevel"] and first.get("behavior") == "Removed" and first.get("invert") is True
        and first.get("pattern") == {"Regex": WORDS} and not pres[1].get("add_prefix_space") and not pres[1].get("use_regex")
        and x.get("model", {}).get("end_of_word_suffix") == "</w>" and not x.get("model", {}).get("dropout")
        and all(t["content"].startswith("<|") for t in x.get("added_tokens") or [])
    )


class Encoder:
    """Ids of texts by the tokenizers library. Where the tokenizer lower-cases, cuts at white space and between
    letters and other signs before anything else (`cuts_at_blanks`), a piece between blanks has the ids of its lower case. Of
    ASCII pieces these are the ids of the parts that it is cut to, one after the other; of others those of the part before a last
    full stop or comma after an ASCII letter, followed by the sign's. Each piece and part is encoded once and remembered;
    REMEMBERED bounds how many. Texts that may hold a special token's name, which isn't lower-cased, are encoded as they
    are, as are all texts by any other tokenizer."""

    def __init__(self, model: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_parts = Tokenizer.from_str(model), cuts_at_blanks(model)
        self.known: dict[bytes, int] = {}  # where a piece is in starts and lengths, which tell its ids' place in values
        self.starts, self.lengths, self.hits = (np.zeros(1 << 16, np.int64) for _ in range(3))
        self.values, self.used = np.zeros(1 << 18, "<u4"), 0
        if not self.by_parts:
            return
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith("</w>")]] = True

    def encode(self, parts: list[bytes]) -> list[bytes]:
        out = []
        for i in range(0, len(parts), 2000):
            found = self.tokenizer.encode_batch_fast([p.decode() for p in parts[i : i + 2000]], add_special_tokens=False)
            out += [np.array(e.ids, "<u4").tobytes() for e in found]
        return out

    def add(self, parts: list[bytes], values: np.ndarray, lengths: np.ndarray) -> None:
        """Remembers parts with their ids one after the other in values."""
        n, size = len(self.known), self.used + len(values)
        if n + len(parts) > len(self.starts):
            self.starts, self.lengths, self.hits = (np.resize(x, 2 * (n + len(parts))) for x in (self.starts, self.lengths, self.hits))
        if size > len(self.values):
            self.values = np.resize(self.values, 2 * size)
        self.values[self.used : size] = values
        self.lengths[n : n + len(parts)] = lengths
        self.starts[n : n + len(parts)] = self.used + np.cumsum(lengths) - lengths
        self.hits[n : n + len(parts)] = 0
        self.known.update(zip(parts, range(n, n + len(parts))))
        self.used = size

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of remembered pieces one after the other, and how many each has."""
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        place = np.repeat(self.starts[at] - ends + lengths, lengths)
        place += np.arange(len(place))
        return self.values[place], lengths

    def encode_parts(self, parts: list[bytes]) -> None:
        """Words of letters alone are encoded many at a time, with blanks between: each ends with a token that
        ends a word. Where their number isn't that of the words, and for all else, each part is encoded."""
        words, single = [], []
        for p in parts:
            (words if len(p) < 100 and (p.isalpha() or p.decode().isalpha()) else single).append(p)
        some = [words[i : i + 200] for i in range(0, len(words), 200)]
        found = self.tokenizer.encode_batch_fast([b" ".join(x).decode() for x in some], add_special_tokens=False)
        for x, e in zip(some, found):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(x) and ends[-1] == len(ids):
                self.add(x, ids, np.diff(ends, prepend=0))
            else:
                single += x
        ids = self.encode(single)
        self.add(single, np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64))

    def remember(self, pieces: list[bytes]) -> None:
        """Pieces, none of them known, each once."""
        known, parts, words, cut = self.known, set(), [], []
        for p in pieces:
            if p.isalpha():
                words.append(p)
                continue
            if p.isascii():
                found = PARTS(p)
            else:
                found = [p[:-1], p[-1:]] if p.endswith((b".", b",")) and 97 <= p[-2] <= 122 else [p]
            parts.update(found)
            if len(found) != 1:
                cut.append((p, found))
        parts.difference_update(words)
        self.encode_parts(words + [p for p in parts if p not in known])
        counts = np.array([len(x) for _, x in cut], np.int64)
        ids, lengths = self.gather(np.fromiter((known[q] for _, x in cut for q in x), np.int64, counts.sum()))
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)]
        self.add([p for p, _ in cut], ids, np.diff(ends, prepend=0))

    def forget(self) -> None:
        """All but the pieces that most batches had, half of REMEMBERED at most."""
        n, least = len(self.known), 2
        while np.count_nonzero(self.hits[:n] >= least) > REMEMBERED // 2:
            least += 1
        kept = self.hits[:n] >= least
        pieces, hits = list(compress(self.known, kept.tolist())), self.hits[:n][kept]
        ids, lengths = self.gather(np.flatnonzero(kept))
        self.known, self.used = {}, 0
        self.add(pieces, ids, lengths)
        self.hits[: len(pieces)] = hits // 2

    def places(self, pieces: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))

    def ids(self, texts) -> list[bytes]:
        """For each text (a list, or pyarrow's array of strings) its ids as little-endian unsigned 32-bit integers."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not self.by_parts:
            return self.encode([x.encode() for x in texts.to_pylist()])
        special = pc.match_substring(texts, "<|")
        words = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(special, "", texts)))
        bounds, coded = words.offsets.to_numpy(), words.flatten().dictionary_encode()
        pieces = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        at = self.places(pieces)
        if len(self.known) + np.count_nonzero(at < 0) > REMEMBERED:
            self.forget()
            at = self.places(pieces)
        unknown = np.flatnonzero(at < 0)
        new = [pieces[i] for i in unknown.tolist()]
        self.remember(new)
        at[unknown] = self.places(new)
        self.hits[at] += 1
        ids, lengths = self.gather(at[coded.indices.to_numpy()])
        bounds, data = (4 * np.concatenate([[0], np.cumsum(lengths)])[bounds - bounds[0]]).tolist(), ids.tobytes()
        out = [data[a:b] for a, b in zip(bounds, bounds[1:])]
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)):
            out[i] = self.encode([texts[i].as_py().encode()])[0]
        return out


#: A worker's encoders by the tokenizer's text; they outlive a task.
ENCODERS: dict[str, Encoder] = {}


def encoder(model: str) -> Encoder:
    if model not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[model] = Encoder(model)
    return ENCODERS[model]


def batched(column: pa.Array, most_bytes: int = 3_000_000):
    """Slices of a column of strings (null: empty) with about so many bytes at most, or one text."""
    column = pc.fill_null(column, "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        yield column.slice(at, end - at)
        at = end


def writer(sink) -> pq.ParquetWriter:
    return pq.ParquetWriter(
        sink, FILE, compression="zstd", use_dictionary=["tokens.list.element"], write_page_index=True, data_page_size=1 << 18,
        dictionary_pagesize_limit=1 << 20, column_encoding={"doc_id": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"},
    )


def write_token_files(docs: DataFrame, tokenizer: str, out: str, end_id: int) -> DataFrame:
    """Writes docs (doc_id, text; null text: empty; other columns are ignored) in ascending order of doc_id,
    equal ones by a hash of the text, a file for each range of ids. tokenizer: the path of its file; its text
    goes to the executors. end_id ends each document. Returns the manifest, a row per file; it is computed
    when it is read, and a task that runs again replaces its file by the same bytes."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Path(tokenizer).read_text())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(model.value).ids
        part = TaskContext.get().partitionId()
        path, file, parquet, n_docs, n_tokens = f"{out}/tokens-{part:06d}.parquet", None, None, 0, 0
        ids, lengths, held, size = [], [], [], 0

        def flush():
            lens = np.array(lengths, np.int32)
            values = np.frombuffer(b"".join(held), "<u4").astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)]).astype(np.int32)
            parquet.write_table(pa.table([pa.array(ids, pa.int64()), pa.array(lens), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], schema=FILE), row_group_size=max(1, len(ids)))

        try:
            for batch in batches:
                names, at = batch.column(0).to_pylist(), 0
                for texts in batched(batch.column(1)):
                    for data in encode(texts):
                        if parquet is None:
                            file = Published(path)
                            parquet = writer(file.sink)
                        data += end
                        ids.append(names[at])
                        at += 1
                        lengths.append(len(data) // 4)
                        held.append(data)
                        size += lengths[-1]
                        n_docs, n_tokens = n_docs + 1, n_tokens + lengths[-1]
                        if size >= GROUP_TOKENS:
                            flush()
                            ids, lengths, held, size = [], [], [], 0
            if parquet is not None:
                if ids:
                    flush()
                parquet.close()
        except BaseException as e:
            if file is not None:
                file.__exit__(type(e), e, None)
            raise
        if file is not None:
            file.__exit__(None, None, None)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())], names=["file", "path", "n_docs", "n_tokens"])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(run, MANIFEST)


def read_digests(spark: SparkSession, files: list) -> DataFrame:
    """files: rows of the manifest. For each document, from the files: where its ids start in the whole, how
    many they are, and their checksum. Starts of files are sums over the manifest, which has a row per file."""
    files, start, todo = sorted(files, key=lambda x: x.file), 0, []
    for x in files:
        todo.append((x.path, start))
        start += x.n_tokens

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, name = open_fs(path)
                with fs.open_input_file(name) as source:
                    for part in pq.ParquetFile(source).iter_batches(batch_size=2048):
                        tokens, lengths = part.column("tokens"), part.column("n_tokens").to_numpy()
                        offsets, values = tokens.offsets.to_numpy(), tokens.values.to_numpy().astype("<u4")
                        sums = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
                        starts = start + np.cumsum(lengths, dtype=np.int64) - lengths
                        start += int(lengths.sum(dtype=np.int64))
                        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(todo, "path string, start long").repartition(max(1, len(todo)))
    return table.mapInArrow(run, DIGEST)


def read_documents(paths: list[str], low: int, high: int, columns: tuple[str, ...] = ("doc_id", "n_tokens", "tokens")) -> pa.Table:
    """Selective read: the documents with low <= doc_id <= high, of the columns named. Row groups whose
    statistics exclude the range aren't read, nor are other columns."""
    found = []
    for path in paths:
        fs, name = open_fs(path)
        found.append(pq.read_table(name, filesystem=fs, columns=list(columns), filters=[("doc_id", ">=", low), ("doc_id", "<=", high)]))
    return pa.concat_tables(found) if found else FILE.empty_table().select(list(columns))


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 2, out: str | None = None) -> DataFrame:
    """Writes the token files of docs and returns what they hold, read back, a row per row of docs."""
    spark = docs.sparkSession
    out = out or shared_path(spark, "tokens")
    return read_digests(spark, write_token_files(docs, tokenizer, out, end_id).collect())
