import struct
import zlib

import cases
import pyarrow.parquet as pq
import pytest

from siltworks.llm.queries import tokenizer_path
from siltworks.llm.token_files import Encoder, read_documents, token_digests, write_token_files


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def expected(tokenizer, rows):
    start, out = 0, []
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_round_trip(spark, tokenizer):
    rows = sorted(((r[0], r[1]) for r in cases.rows() if r[0] is not None), key=lambda r: (r[0], r[1] or ""))
    d = spark.createDataFrame(rows[::-1], "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_digests(d, tokenizer_path()).collect())
    assert got == sorted(expected(tokenizer, rows))


def test_encoder_is_the_library(tokenizer):
    import random

    rng = random.Random(5)
    parts = ["a", "B", "'s", "'S", ".", " ", ",", "\u0301", "é", "İ", "ﬁ", "中", "1", "!", "...", "\n", "\u00a0", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "ΑΣ", "x.", "y,", "é.", "3."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["", "x" * 50_000]
    encoder = Encoder(open(tokenizer_path()).read())
    want = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.ids(texts) == want


def test_files(spark, tmp_path):
    d = cases.documents(spark, extra=True).where("doc_id < 5")
    paths = [r.path for r in write_token_files(d, tokenizer_path(), f"file://{tmp_path}", 2).collect()]
    meta = pq.ParquetFile(paths[0].removeprefix("file://")).metadata
    kinds = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in kinds["doc_id"].encodings and "RLE_DICTIONARY" in kinds["tokens.list.element"].encodings
    assert kinds["doc_id"].has_offset_index and kinds["doc_id"].has_column_index
    some = read_documents(paths, 2, 3, ("doc_id", "n_tokens"))
    assert sorted(some["doc_id"].to_pylist()) == [2, 3] and some.column_names == ["doc_id", "n_tokens"]
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".part")]


def test_empty(spark):
    assert token_digests(cases.empty(spark), tokenizer_path()).count() == 0


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    with open(path) as f:
        mine = Encoder(f.read())
    assert not mine.by_parts
    texts = ["", "Hello  World, it's HERE.\n\nNew line", "  leading", "caf\u00e9 \u4e2d\u6587 <|endoftext|>", "x" * 5000]
    assert mine.ids(texts) == [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in (library.encode(t, add_special_tokens=False) for t in texts)]
    with open(tokenizer_path()) as f:
        assert Encoder(f.read()).by_parts


class Recorder:
    """A tokenizer that notes what it is asked to encode."""

    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, []

    def __getattr__(self, name):
        def call(texts, **options):
            self.asked += " ".join([texts] if isinstance(texts, str) else texts).split()
            return getattr(self.tokenizer, name)(texts, **options)

        return call


def test_parts_of_pieces_are_encoded_once(tokenizer, monkeypatch):
    from siltworks.llm import token_files

    def ids(texts):
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in (tokenizer.encode(t, add_special_tokens=False) for t in texts)]

    with open(tokenizer_path()) as f:
        encoder = Encoder(f.read())
    encoder.ids(["alpha beta gamma"])
    encoder.tokenizer = seen = Recorder(encoder.tokenizer)
    texts = ["(Alpha) beta! alpha-beta?", "gamma's 12 ''s", "Beta."]
    assert encoder.ids(texts) == ids(texts)
    assert sorted(seen.asked) == sorted(["(", ")", "!", "-", "?", "'s", "1", "2", "''", "s", "."])
    seen.asked.clear()
    monkeypatch.setattr(token_files, "REMEMBERED", 20)
    for i in range(30):
        texts = [f"often {'x' * (i + 1)} q{'y' * i}z often."]
        assert encoder.ids(texts) == ids(texts)
    assert seen.asked.count("often") == 1 and len(encoder.known) <= 25


def test_encoder_is_the_library_on_ascii(tokenizer, monkeypatch):
    import random

    from siltworks.llm import token_files

    rng = random.Random(6)
    parts = [chr(i) for i in range(128)] + ["'s", "'ll", "'", "''", "don't", "word", "Word.", "\x1c", "\x1f", "\x85", " ", "été.", "ça,", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    want = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    with open(tokenizer_path()) as f:
        encoder = Encoder(f.read())
    assert encoder.ids(texts) == want
    monkeypatch.setattr(token_files, "REMEMBERED", 300)
    assert [x for i in range(0, 3000, 50) for x in encoder.ids(texts[i : i + 50])] == want
