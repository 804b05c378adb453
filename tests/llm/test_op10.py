import gzip
import hashlib
import io

import duckdb

from mnemospark.llm import op10_warc as op


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    got = sorted(map(str, map(tuple, op.op10_warc(spark, sf).collect())))
    assert got == sorted(map(str, con.sql(op.ORACLE).fetchall()))


def test_edges(spark, tmp_path):
    rows = [(5, "http://a\r\nb", "same", 1), (2, None, "same", 1), (2, None, "same", 2), (None, "u", "same", 1), (9, "u", None, 1), (8, "u", "", 1), (7, "u", "é" * 300_000, 1), (None, "u", "only", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, first int")
    files = op.write_warc(pages, f"{tmp_path}/w")
    got = op.read_warc(files, keep_payload=True).collect()
    assert all(r.error is None and r.digest_ok is not False for r in got)
    types = sorted(str((r.record_id, r.record_type, r.refers_to, r.payload_bytes)) for r in got)
    assert types == sorted(map(str, [
        ("urn:page:2", "response", None, 4), ("urn:page:2", "response", None, 4), ("urn:page:5", "revisit", "urn:page:2", 4), ("urn:page:null", "revisit", "urn:page:2", 4), ("urn:page:null", "response", None, 4),
        ("urn:page:8", "response", None, 0), ("urn:page:9", "revisit", "urn:page:8", 0), ("urn:page:7", "response", None, 600_000),
    ]))
    assert {r.payload for r in got if r.record_id == "urn:page:7"} == {("é" * 300_000).encode()}
    few = op.write_warc(pages, f"{tmp_path}/v", least=5)
    assert {r.record_type for r in op.read_warc(few).collect()} == {"response"}
    assert op.read_warc(op.write_warc(pages.limit(0), f"{tmp_path}/u")).count() == 0


def test_damaged_records():
    good = op.record(1, "u", b"abc", None, "d") + op.record(2, "v", b"x" * 100_000, None, "d")
    assert [r["record_id"] for r in op.WarcReader(io.BytesIO(good), piece=50)] == ["urn:page:1", "urn:page:2"]
    first, cut = list(op.WarcReader(io.BytesIO(good[:-20])))
    assert first["error"] is None and cut["error"]
    assert [bool(r["error"]) for r in op.WarcReader(io.BytesIO(b"junk"))] == [True]
    for refers in (None, 1):  # a changed block is told by its digest, in revisits too
        plain = gzip.decompress(op.record(2, "v", b"x" * 50, refers, "d"))
        (r,) = op.WarcReader(io.BytesIO(gzip.compress(plain)))
        assert r["digest_ok"] and r["error"] is None
        (r,) = op.WarcReader(io.BytesIO(gzip.compress(plain.replace(b"200 OK", b"200 KO"))))
        assert r["digest_ok"] is False and r["error"] is None
    assert op.base32_sha1(b"") == __import__("base64").b32encode(hashlib.sha1(b"").digest()).decode()
