"""WARC archives: one gzip member per record, written and read as a stream."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Published, fresh, materialise, open_fs, shared_path

#: A new archive begins after so many bytes.
ARCHIVE_BYTES = 1 << 30
#: Bytes read, and bytes inflated, at a time.
CHUNK = 1 << 18
#: Digests that the reader can verify, and how long each is.
DIGESTS = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, n_records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, position long, digest_ok boolean"


def digest_of(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page}/{digest}')}>"


def clean(value: str) -> str:
    """A header's value has no line ends."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page: int | None, url: str | None, payload: bytes, first: int | None, original: str | None) -> bytes:
    """One record, packed as a gzip member. first: the page whose response has the same payload, if this is a
    revisit; then the block is the HTTP head alone, whose Content-Length tells the payload's."""
    digest = digest_of(hashlib.sha1(payload))
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if first is not None else head + payload
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", DATE),
        ("WARC-Target-URI", url and clean(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{digest_of(hashlib.sha1(block))}"),
        ("X-Page", None if page is None else str(page)), ("Content-Type", "application/http; msgtype=response"),
    ]
    if first is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, digest)), ("WARC-Refers-To-Target-URI", original and clean(original)), ("X-Refers-To-Page", str(first))]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def members(source) -> Iterator[tuple[int, Iterator[bytes]]]:
    """Of a stream of gzip members: where each begins, and its contents in chunks of CHUNK bytes at most. The
    next member may be asked for before a member's contents are read to the end; they are read then."""
    state = {"data": source.read(CHUNK), "at": 0}

    def contents():
        unpacker = zlib.decompressobj(31)
        while not unpacker.eof:
            if not state["data"]:
                state["data"] = source.read(CHUNK)
            size = len(state["data"])
            try:
                out = unpacker.decompress(state["data"], CHUNK)
            except zlib.error as e:
                raise ValueError(f"not a gzip member: {e}") from e
            if not size and not out and not unpacker.eof:
                raise ValueError("an archive ends within a record")
            state["data"] = unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail
            state["at"] += size - len(state["data"])
            if out:
                yield out

    while state["data"] or (refill := source.read(CHUNK)):
        if not state["data"]:
            state["data"] = refill
        part = contents()
        yield state["at"], part
        for _ in part:
            pass


class Framed:
    """Takes bytes from chunks: head() up to an empty line, take(n) exactly n bytes in chunks, ended() at the end."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.data = chunks, b""

    def more(self) -> None:
        part = next(self.chunks, b"")
        if not part:
            raise ValueError("a record is shorter than its headers tell")
        self.data += part

    def head(self) -> bytes:
        seen = 0
        while (end := self.data.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(self.data) - 3)
            self.more()
        head, self.data = self.data[: end + 4], self.data[end + 4 :]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.data:
                self.more()
            part, self.data = self.data[:n], self.data[n:]
            n -= len(part)
            yield part

    def ended(self) -> bool:
        return not self.data and not any(self.chunks)


def parsed(head: bytes) -> tuple[str, dict[str, str]]:
    """The first line, and the fields by their names in lower case; lines that begin with a blank go on with the field before."""
    first, *lines = head.decode("utf-8", "replace").rstrip("\r\n").split("\r\n")
    fields: dict[str, str] = {}
    name = ""
    for x in lines:
        if x[:1] in (" ", "\t") and name:
            fields[name] += " " + x.strip()
            continue
        name, colon, value = x.partition(":")
        if not colon:
            raise ValueError(f"a header without a name: {x[:40]!r}")
        name = name.strip().lower()
        fields[name] = value.strip()
    return first, fields


def whole_number(value: str | None) -> int | None:
    return int(value) if value and value.isascii() and value.isdigit() else None


class Digest:
    """A digest as a header tells it, `algorithm:value` with the value in base 32 or hex, and what it should be."""

    def __init__(self, told: str | None):
        self.algorithm, _, self.value = (told or "").partition(":")
        self.algorithm = self.algorithm.lower().replace("-", "")
        self.known = self.algorithm in DIGESTS
        self.hash = hashlib.new(self.algorithm) if self.known else None

    def update(self, part: bytes) -> None:
        if self.hash is not None:
            self.hash.update(part)

    def holds(self) -> bool | None:
        """Null if there is none, or one of an algorithm that isn't known."""
        if self.hash is None:
            return None
        if len(self.value) == 2 * DIGESTS[self.algorithm]:
            return self.value.lower() == self.hash.hexdigest()
        return self.value.upper().rstrip("=") == digest_of(self.hash).rstrip("=")


def read_archive(source, payloads: bool = False) -> Iterator[dict]:
    """The records of an archive of any writer, one after the other, of each kind. A block is as long as Content-Length tells; in
    blocks of type application/http the payload begins after the HTTP head, if that ends within the block (if it
    doesn't, there is no payload), others are all payload. payload_bytes and payload_digest (SHA-1) are of the
    payload; a revisit's is elsewhere, so they are as its headers tell, null where they don't. digest_ok: the digests
    told for block and payload hold (for a revisit, the block's alone); null if none can be verified. Memory: two
    chunks and the headers (and a payload, if payloads). Bad framing, as by a length that isn't a number, an
    archive that ends within a record, or bytes after a record in its member, raises ValueError."""
    for position, chunks in members(source):
        framed = Framed(chunks)
        version, fields = parsed(framed.head())
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        length, kind = whole_number(fields.get("content-length")), fields.get("warc-type", "").lower()
        if length is None:
            raise ValueError("a record without a length")
        in_head, head = fields.get("content-type", "").lower().startswith("application/http"), b""
        block, payload = Digest(fields.get("warc-block-digest")), Digest(fields.get("warc-payload-digest"))
        sha1, n, kept = hashlib.sha1(), 0, []
        for part in framed.take(length):
            block.update(part)
            if in_head:
                seen = max(0, len(head) - 3)
                head += part
                if (end := head.find(b"\r\n\r\n", seen)) < 0:
                    continue
                head, part, in_head = head[: end + 4], head[end + 4 :], False
            payload.update(part)
            sha1.update(part)
            n += len(part)
            if payloads:
                kept.append(part)
        if b"".join(framed.take(4)) != b"\r\n\r\n" or not framed.ended():
            raise ValueError("a record doesn't end as it should")
        revisit = kind == "revisit"
        held = [x for x in (block.holds(), None if revisit else payload.holds()) if x is not None]
        if revisit:
            told = fields.get("warc-payload-digest")
            digest, n = told and told.removeprefix("sha1:"), http_length(head)
        else:
            digest = digest_of(sha1)
        yield {
            "page_id": whole_id(fields.get("x-page")), "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": whole_id(fields.get("x-refers-to-page")),
            "position": position, "digest_ok": all(held) if held else None, "url": fields.get("warc-target-uri"), "record_id": fields.get("warc-record-id"),
        } | ({"payload": b"".join(kept)} if payloads else {})


def http_length(head: bytes) -> int | None:
    """What an HTTP head tells of the length of its body."""
    try:
        return whole_number(parsed(head)[1].get("content-length")) if head else None
    except ValueError:
        return None


def whole_id(value: str | None) -> int | None:
    return None if value is None or whole_number(value.removeprefix("-")) is None else int(value)


def write_archives(pages: DataFrame, out: str, least: int = 0) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html; null html: no bytes), archives of ARCHIVE_BYTES
    or so from each partition. Of rows with equal payloads of least bytes or more, that with the smallest
    page_id is the response (rows that repeat it too), the others are revisits of it; a null page_id is larger than others, and where
    all are null, all are responses. Returns the manifest, a row per archive, computed when it is read.

    Payloads are compared by SHA-1. Only digests are grouped; one that half of all pages have is a row for
    each task. The join with the first page of each repeated digest can be split where it is hot."""
    sha, first, original = fresh(pages, "sha1", "first_page", "first_url")
    data = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(data).alias(sha))
    firsts = (
        pages.where(F.octet_length(data) >= least).select("page_id", "url", F.sha1(data).alias(sha))
        .groupBy(sha).agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("f"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select(sha, F.col("f.page_id").alias(first), F.col("f.url").alias(original))
    )
    firsts = materialise(firsts, "warc-firsts")

    def run(batches):
        part, seq, archive, n = TaskContext.get().partitionId(), 0, None, 0
        path = ""
        try:
            for batch in batches:
                for page, url, html, first, original in zip(*(batch.column(i) for i in range(5))):
                    if archive is None:
                        path = f"{out}/archive-{part:06d}-{seq:04d}.warc.gz"
                        archive, n, seq = Published(path), 0, seq + 1
                    page, first, text = page.as_py(), first.as_py(), html.as_py() or ""
                    again = first if first != page else None
                    archive.sink.write(record(page, url.as_py(), text.encode(), again, original.as_py()))
                    n += 1
                    if archive.sink.tell() >= ARCHIVE_BYTES:
                        archive.__exit__(None, None, None)
                        archive = None
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "n_records"])
        except BaseException as e:
            if archive is not None:
                archive.__exit__(type(e), e, None)
            raise
        if archive is not None:
            archive.__exit__(None, None, None)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "n_records"])

    return rows.join(firsts, sha, "left").select("page_id", "url", "html", first, original).mapInArrow(run, MANIFEST)


def read_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The records of the archives, each read by one task as a stream."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = open_fs(path)
                rows = []
                with fs.open_input_stream(name, compression=None) as source:
                    for x in read_archive(source):
                        rows.append(x | {"path": path})
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds)], names=names)

    table = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return table.mapInArrow(run, RECORDS)


def warc_round_trip(pages: DataFrame, out: str | None = None, least: int = 0) -> DataFrame:
    """Writes pages as archives and returns their records as read back, a row per row of pages."""
    spark = pages.sparkSession
    manifest = write_archives(pages, out or shared_path(spark, "warc"), least).collect()
    return read_archives(spark, [x.path for x in manifest])
