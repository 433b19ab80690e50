import base64
import gzip
import hashlib
import io

import pytest

from siltworks.llm.warc import read_archive, record, warc_round_trip, write_archives

PAGE = "page_id long, url string, html string, path string, sha1 string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGE)


def test_round_trip(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 40} é</p>" * (1 + i % 7)) for i in range(300)] + [(900, None, None), (901, "u\r\nX: y", ""), (902, "", "z" * 3_000_000), (None, "n", "alone"), (7, "http://h/7", "<p>7 é</p>")]
    got = warc_round_trip(pages(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.digest_ok for r in got)
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", 10**9))
    by = {}
    for i, _, html in rows:
        by.setdefault(i, []).append((html or "").encode())
    for r in got:
        data = [x for x in by[r.page_id] if base64.b32encode(hashlib.sha1(x).digest()).decode() == r.payload_digest]
        assert data and r.payload_bytes == len(data[0])
        if r.page_id is not None:
            want = first[data[0].decode()]
            assert (r.record_type, r.refers_to) == (("response", None) if want == r.page_id else ("revisit", want))


def test_one_member_a_record(spark, tmp_path):
    out = f"file://{tmp_path}"
    assert [r.n_records for r in write_archives(pages(spark, [(1, "a", "x"), (2, "b", "y")]).coalesce(1), out).collect()] == [2]
    data = b"".join(p.read_bytes() for p in tmp_path.iterdir() if p.suffix == ".gz")
    found = list(read_archive(io.BytesIO(data), payloads=True))
    assert [(r["page_id"], r["payload"], r["url"]) for r in found] == [(1, b"x", "a"), (2, b"y", "b")]
    text = gzip.decompress(data[found[1]["position"] :]).decode()
    assert text.startswith("WARC/1.1\r\n") and text.endswith("\r\n\r\n") and "WARC-Block-Digest: sha1:" in text


def test_damage_is_seen():
    good = record(1, "u", b"payload" * 1000, None, None)
    with pytest.raises(ValueError):
        list(read_archive(io.BytesIO(good[:-20])))
    body = gzip.decompress(good)
    bad = gzip.compress(body.replace(b"payloadpay", b"paylOadpay", 1))
    assert [r["digest_ok"] for r in read_archive(io.BytesIO(good + bad))] == [True, False]
    with pytest.raises(ValueError):
        list(read_archive(io.BytesIO(gzip.compress(b"HTTP/1.1 200\r\n\r\n"))))


def test_empty(spark):
    assert warc_round_trip(pages(spark, [])).count() == 0


def member(fields, block, tail=b"\r\n\r\n"):
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return gzip.compress(head.encode() + block + tail)


def test_records_of_other_writers():
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    body = b"body" * 200_000
    sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
    records = [
        ({"WARC-Type": "warcinfo", "Content-Type": "application/warc-fields"}, b"software: x\r\n"),
        ({"WARC-Type": "request", "Content-Type": "application/http; msgtype=request"}, b"GET / HTTP/1.1\r\nHost: h\r\n\r\n"),
        ({"WARC-Type": "response", "Content-Type": "application/http; msgtype=response", "WARC-Target-URI": "http://h/"}, http + body),
        ({"WARC-Type": "response", "Content-Type": "application/http", "WARC-Payload-Digest": f"sha1:{sha}"}, http + body),
        ({"WARC-Type": "response", "Content-Type": "application/http", "WARC-Payload-Digest": f"sha-256:{hashlib.sha256(body).hexdigest()}"}, http + body),
        ({"WARC-Type": "response", "Content-Type": "application/http", "WARC-Payload-Digest": "crc9:00"}, http + body),
        ({"WARC-Type": "resource", "Content-Type": "text/html", "WARC-Block-Digest": f"sha1:{'A' * 32}"}, body),
        ({"WARC-Type": "metadata"}, b""),
        ({"WARC-Type": "conversion", "Content-Type": "text/plain"}, b"\r\n\r\nplain"),
        ({"WARC-Type": "revisit", "Content-Type": "application/http"}, b""),
        ({"WARC-Type": "response", "Content-Type": "application/http"}, b"HTTP/1.1 200 OK"),
        ({"WARC-Type": "continuation", "X-Folded": "a\r\n b"}, b"rest"),
    ]
    data = b"".join(member(f | {"Content-Length": len(b)}, b) for f, b in records)
    got = list(read_archive(io.BytesIO(data), payloads=True))
    assert [r["record_type"] for r in got] == [f["WARC-Type"] for f, _ in records]
    assert [len(r["payload"]) for r in got] == [13, 0, 800_000, 800_000, 800_000, 800_000, 800_000, 0, 9, 0, 0, 4]
    assert [r["digest_ok"] for r in got] == [None, None, None, True, True, None, False] + [None] * 5
    assert got[2]["payload_digest"] == sha and got[9]["payload_bytes"] is None and got[2]["page_id"] is None


@pytest.mark.parametrize("length, tail", [("-5", b"\r\n\r\n"), ("x", b"\r\n\r\n"), ("", b"\r\n\r\n"), ("3", b"\r\n\r\n"), ("90", b"\r\n\r\n"), ("4", b""), ("4", b"\r\n\r\nWARC/1.0\r\n")])
def test_bad_framing_raises(length, tail):
    with pytest.raises(ValueError):
        list(read_archive(io.BytesIO(member({"WARC-Type": "resource", "Content-Length": length}, b"data", tail))))
    with pytest.raises(ValueError):
        list(read_archive(io.BytesIO(b"no gzip at all")))


def test_long_url_comes_back(spark):
    url = "http://h/" + "a" * 3_000_000
    assert [r["url"] for r in read_archive(io.BytesIO(record(1, url, b"x", None, None)))] == [url]
