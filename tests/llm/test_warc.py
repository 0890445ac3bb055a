"""WARC archives: exact round trips and shared payloads."""

import base64
import datetime
import hashlib
import re

from quadspark.llm.common import Workspace
from quadspark.llm.warc import export_warc, read_archive, read_warc, write_archive

ROWS = [
    (1, "http://a/1", "<p>é</p>"), (5, "http://a/5", "<p>é</p>"), (3, "http://a/3", "<p>é</p>"), (2, None, ""), (7, "http://x\r\nEvil: 1", None),
    (9, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"), (10, "v", "x" * 200_000), (None, "n", "null id"), (11, "d", "twice"), (11, "d", "twice"),
]


def read(spark, rows, **k):
    path = Workspace(spark, "test").path
    write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path, **k)
    return path, read_archive(spark, path)


def fields(r):
    return dict(x.split(": ", 1) for x in bytes(r.record).partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_records(spark):
    path, df = read(spark, ROWS)
    got = df.collect()
    assert len(got) == len(ROWS)
    top = {}
    for i, _, h in ROWS:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    html = {(i, u): h or "" for i, u, h in ROWS}
    for r in got:
        h = next(v for (i, _), v in html.items() if i == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(h.encode()), digest(h))
        assert r.record_type == ("response" if r.page_id is None or top[h] == r.page_id else "revisit")
        assert r.refers_to == (None if r.record_type == "response" else top[h])
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        http, _, body = block.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and body == (h.encode() if r.record_type == "response" else b"") + b"\r\n\r\n"
        assert http.startswith(b"HTTP/1.1 200 OK\r\n") and http.endswith(b"\r\nContent-Length: %d" % len(h.encode()))
        assert fields(r)["Content-Length"] == str(len(block) - 4)
        assert b"\nEvil" not in head
    by_id = {fields(r)["WARC-Record-ID"]: r for r in got}
    assert len(by_id) == len(got) and all(re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", k) for k in by_id)
    for r in got:
        if r.record_type == "revisit":
            f = fields(r)
            to = by_id[f["WARC-Refers-To"]]
            assert (to.page_id, to.record_type, to.payload_digest) == (r.refers_to, "response", r.payload_digest)
            assert (f["WARC-Refers-To-Target-URI"], f["WARC-Refers-To-Date"]) == (to.url, fields(to)["WARC-Date"])
    assert spark.read.parquet(f"{path}/payloads").count() == len(top)


def test_small_payloads_are_all_responses(spark):
    _, df = read(spark, ROWS, min_bytes=100)
    assert all(r.record_type == "response" for r in df.collect())


def test_plain_files(spark, tmp_path):
    _, df = read(spark, ROWS)
    export_warc(df, str(tmp_path / "w"), 3)
    want = sorted(bytes(r.record) for r in df.collect())
    assert sorted(bytes(r.header) + bytes(r.block) + b"\r\n\r\n" for r in read_warc(spark, str(tmp_path / "w")).collect()) == want


def test_empty_and_extra_columns(spark):
    assert read(spark, [])[1].collect() == []
    path = Workspace(spark, "test").path
    write_archive(spark.createDataFrame([(1, "u", "h", "x", 3)], "page_id long, url string, html string, sha256 string, top int"), path)
    assert read_archive(spark, path).count() == 1


def test_null_and_minus_one_share_a_payload(spark):
    _, df = read(spark, [(None, "n", "same"), (-1, "m", "same"), (-1, "m2", "same"), (-7, "k", "same")])
    got = sorted((r.page_id is None, r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in df.collect() if r.page_id is not None)
    assert got == [(False, -7, "revisit", -1, 4), (False, -1, "response", None, 4), (False, -1, "response", None, 4)]
    null = [r for r in df.collect() if r.page_id is None]
    assert [(r.record_type, r.refers_to) for r in null] == [("revisit", -1)]
    only = read(spark, [(None, "n", "a"), (None, "n", "a")])[1].collect()
    assert [(r.page_id, r.record_type, r.refers_to) for r in only] == [(None, "response", None)] * 2


def test_dates(spark):
    path = Workspace(spark, "test").path
    at = datetime.datetime(2024, 2, 29, 12, 30, 5, tzinfo=datetime.UTC)
    write_archive(spark.createDataFrame([(1, "u", "h", at), (2, "u", "h", None)], "page_id long, url string, html string, crawled timestamp"), path, date_col="crawled")
    got = {r.page_id: fields(r) for r in read_archive(spark, path).collect()}
    assert got[1]["WARC-Date"] == "2024-02-29T12:30:05Z" and re.fullmatch(r"20\d\d-\d\d-\d\dT\d\d:\d\d:\d\dZ", got[2]["WARC-Date"])
    assert got[1]["WARC-Refers-To-Date"] == got[2]["WARC-Date"]
