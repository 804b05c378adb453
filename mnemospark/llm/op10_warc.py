"""WARC archives: writing with payload deduplication, and a sequential reader.

Each record is a gzip member of its own.  The reader walks a file once: it inflates
member after member piece by piece, frames the block by Content-Length, and checks
the digests of block and payload; it never holds more than one record.  Of records with equal
payloads of at least `least` bytes the one of smallest id is a response, the others
are revisits of it (identical-payload-digest) whose block holds the HTTP head alone.

Defined cases: null payload is empty; a null id is written as urn:page:null and is
never referred to while its payload has an id; rows that tie on the smallest id are
all responses; line ends in URLs are percent-encoded, a null URL is empty; an empty
table gives no archive and no row; further columns are ignored.  In reading, a
damaged or cut-off record gives a row with `error` set and ends its file; a record whose
block or payload has another digest than it names has digest_ok false (null if it names
none; a revisit's payload digest is that of the record it refers to and is not checked).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "path string, offset long, record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, digest_ok boolean, error string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    """One gzip member."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


class WarcReader:
    """Records of an open .warc.gz, in order.  The payload is handed over only if asked for."""

    def __init__(self, src, keep_payload: bool = False, piece: int = 1 << 18):
        self.src, self.keep, self.piece = src, keep_payload, piece
        self.raw, self.at = b"", 0

    def _member(self):
        """Inflated pieces of the next member; self.raw keeps what follows it."""
        z = zlib.decompressobj(31)
        while not z.eof:
            if not self.raw:
                self.raw = self.src.read(self.piece)
                if not self.raw:
                    raise EOFError("cut off inside a record")
            out = z.decompress(self.raw, self.piece)
            left = z.unused_data if z.eof else z.unconsumed_tail
            self.at += len(self.raw) - len(left)
            self.raw = left
            if out:
                yield out

    def __iter__(self):
        while True:
            if not self.raw:
                self.raw = self.src.read(self.piece)
            if not self.raw:
                return
            offset = self.at
            try:
                yield {"offset": offset, "error": None, **self._record()}
            except (EOFError, ValueError, zlib.error) as e:
                yield {"offset": offset, "error": str(e)}
                return

    def _record(self) -> dict:
        pieces, data = self._member(), b""

        def until(mark: bytes) -> bytes:
            nonlocal data
            while (k := data.find(mark)) < 0:
                more = next(pieces, None)
                if more is None:
                    raise ValueError("no end of head")
                data += more
            head, data = data[:k], data[k + len(mark) :]
            return head

        lines = until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        left = int(head["content-length"]) if head.get("content-length", "").isdigit() else -1
        if left < 0:
            raise ValueError("no Content-Length")
        declared, block = None, hashlib.sha1()
        if head.get("content-type", "").startswith("application/http"):
            http = until(b"\r\n\r\n")
            block.update(http + b"\r\n\r\n")
            left -= len(http) + 4
            if left < 0:
                raise ValueError("longer than its Content-Length")
            declared = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length" and v.strip().isdigit()), None)
        sha, size, kept = hashlib.sha1(), 0, []
        while True:
            part = data[: left - size]
            sha.update(part)
            block.update(part)
            size += len(part)
            if self.keep:
                kept.append(part)
            if size == left:
                break
            data = next(pieces, None)
            if data is None:
                raise ValueError("shorter than its Content-Length")
        data = data[len(part) :]
        for more in pieces:
            data += more
        if data != b"\r\n\r\n":
            raise ValueError("longer than its Content-Length")
        named, whole = (head.get(f"warc-{x}-digest", "").removeprefix("sha1:") for x in ("payload", "block"))
        revisit = head.get("warc-type") == "revisit"
        said = lambda sha, name: not name or base64.b32encode(sha.digest()).decode() == name
        checked = [said(block, whole)] * bool(whole) + [said(sha, named)] * (bool(named) and not revisit)
        return {
            "record_id": head.get("warc-record-id", "").strip("<>"), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"), "refers_to": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None,
            "payload_bytes": declared if revisit else size, "payload_digest": named, "digest_ok": all(checked) if checked else None, "payload": b"".join(kept) if self.keep else None,
        }


def write_warc(pages: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z", roll: int = 1 << 30) -> DataFrame:
    """Archives of all rows; returns the manifest (path, n_records).

    What a lost task has left stands in no manifest and is never read.
    """
    rows = pages.select(shared.quoted(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    firsts = shared.stored(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")), "firsts", f"{out_dir}/_firsts")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    joined = shared.lookup(rows, firsts, "digest", total)
    refers = F.when((F.octet_length("payload") >= least) & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))

    def write(batches):
        fs, folder = shared.open_fs(out_dir)
        out, name, n, size, done = None, "", 0, 0, []
        for b in batches:
            for k in range(b.num_rows):
                page_id, url, payload, refers_to = (b.column(c)[k].as_py() for c in range(4))
                if out is None or size >= roll:
                    if out:
                        out.close()
                        done.append((f"{out_dir}/{name}", n))
                    name, n, size = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                data = record(page_id, url, payload, refers_to, date)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out:
            out.close()
            done.append((f"{out_dir}/{name}", n))
            yield pa.RecordBatch.from_pydict({"path": [p for p, _ in done], "n_records": [n for _, n in done]}, schema=pa.schema([("path", pa.string()), ("n_records", pa.int64())]))

    made = joined.select("id", "url", F.col("payload").cast("binary").alias("payload"), refers.alias("refers_to")).mapInArrow(write, "path string, n_records long")
    return shared.stored(made, "manifest", f"{out_dir}/_manifest")


def read_warc(files: DataFrame, keep_payload: bool = False) -> DataFrame:
    """The records of the archives in column `path`, a row each."""
    fields = [x.split(" ")[0] for x in READ.split(", ")] + ["payload"] * keep_payload
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split(" ")[0], kinds[x.split(" ")[1]]) for x in READ.split(", ")] + [("payload", pa.binary())] * keep_payload)

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = shared.open_fs(path)
                with fs.open_input_stream(at, compression=None) as src:
                    rows, held = [], 0
                    for r in WarcReader(src, keep_payload):
                        rows.append({"path": path} | r)
                        held += 500 + (len(r.get("payload") or b"") if keep_payload else 0)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist([{f: x.get(f) for f in fields} for x in rows], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist([{f: x.get(f) for f in fields} for x in rows], schema=schema)

    paths = files.select("path")
    return paths.repartition(max(1, min(paths.count(), 20_000))).mapInArrow(read, READ + ", payload binary" * keep_payload)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_warc(shared.table(spark, sf_dir, "pages"), shared.scratch(spark, "warc"))
    page = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    rows = read_warc(files).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), page("refers_to")).alias("refers_to"),
        F.assert_true(F.col("error").isNull() & F.coalesce("digest_ok", F.lit(True)), F.concat(F.lit("bad record in "), F.col("path"))).alias("checked"),
    )
    return rows.filter(F.col("checked").isNull()).drop("checked")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
d AS (SELECT page_id, h, first, sha1(h) AS x FROM p JOIN f USING (h))
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((('0x' || substr(x, CAST(k // 4 * 5 + 1 AS BIGINT), 5))::BIGINT >> CAST(15 - k % 4 * 5 AS BIGINT)) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
