"""Packing along a space-filling curve.

A document's token ids are hashed into FEATURES counters; their square roots, at unit
length, are projected to DIMS dimensions by a fixed matrix, and the Hilbert key of
the projected point orders the documents.  The corpus is range-sorted by that key
(then by id), and neighbours along the curve are laid end to end into sequences of
LENGTH tokens; a document is cut where a sequence ends.  Only the rest of a partition
is less than LENGTH: it is cut at powers of two, which need no padding.

Equal texts have equal keys; the id breaks the tie, so copies spread over partitions.

Defined cases: null or empty text is the end id alone; a null doc_id sorts first and
is kept; repeated rows are each packed; a long text is encoded whole and sorted in segments;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, wordcache

LENGTH, FEATURES, DIMS, BITS, CACHE = 2048, 256, 4, 15, 400_000
#: Tokens in a row of the sort: longer documents are rows of several segments, so rows
#: and with them range partitions are of bounded size.
SEGMENT = 4 * LENGTH
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def projection() -> np.ndarray:
    """FEATURES x DIMS numbers from a fixed integer hash, about normally distributed."""
    with np.errstate(over="ignore"):
        x = np.arange(FEATURES * DIMS * 12, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    u = (x >> np.uint64(11)).astype(np.float64) / 2.0**53
    return (u.reshape(FEATURES, DIMS, 12).sum(axis=2) - 6) / 2


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Key of each row of non-negative integers below 2**bits along the Hilbert curve."""
    x = points.astype(np.int64).T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections, from the coarsest level down
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(on, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(ids: list[np.ndarray], matrix: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents given by their token ids."""
    if not ids:
        return np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        v = np.stack([np.bincount(((x.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(56)).astype(np.int64), minlength=FEATURES) for x in ids])
    v = np.sqrt(v)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    p = (np.clip(v @ matrix, -2, 2) + 2) / 4
    return hilbert(np.minimum((p * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def tokenized(docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE) -> DataFrame:
    """key, doc_id, start, doc_tokens, ids (little-endian; 2 bytes each if wide = 2, else 4) of each
    segment of each row; all segments of a document have its key."""
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        shared.trim(tokenizer)
        tok, matrix = wordcache.load(tokenizer, cache), projection()
        for b in batches:
            for c in range(0, b.num_rows, 256):
                part = b.slice(c, 256)
                ids = [np.frombuffer(tok.encode(t.as_py() or "") + end, dtype="<u4") for t in part.column(1)]
                keys = curve_keys(ids, matrix).tolist()
                rows = []
                for key, doc_id, x in zip(keys, part.column(0).to_pylist(), ids):
                    wide = 2 if not len(x) or x.max() < 65536 else 4
                    for start in range(0, len(x), SEGMENT):
                        rows.append((key, doc_id, start, len(x), wide, x[start : start + SEGMENT].astype(f"<u{wide}").tobytes()))
                if rows:
                    kinds = [*[pa.int64()] * 4, pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=["key", "doc_id", "start", "doc_tokens", "wide", "ids"])

    rows = docs.select(shared.quoted(id_col).cast("long").alias("doc_id"), shared.quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, doc_id long, start long, doc_tokens long, wide int, ids binary")


def pack(docs: DataFrame, tokenizer: str, end_id: int | None, length: int = LENGTH, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE) -> DataFrame:
    """The pieces of all sequences; with keep_ids also their ids (little-endian unsigned 32-bit).  A Python
    worker keeps the ids of about `cache` words, some 400 bytes each; the pieces are the same with any number."""
    path = shared.scratch(docs.sparkSession, "tokens")
    tokens = shared.stored(tokenized(docs, tokenizer, end_id, id_col, text_col, cache), "tokens", path)
    order = [F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("start")]
    names = [x.split(" ")[0] for x in PIECES.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        sequence, room, rows, held, size = first, length, [], [], 0

        def batch(rows):
            out = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:7]]
            return pa.RecordBatch.from_arrays(out + [pa.array([r[7] for r in rows], pa.binary())] * keep_ids, names=names + ["ids"] * keep_ids)

        def piece(segment, at, n, sequence, offset):
            doc_id, start, doc_tokens, data = segment
            part = data[4 * at : 4 * (at + n)]
            return (doc_id, start + at, n, zlib.crc32(part), doc_tokens, sequence, offset, part if keep_ids else None)

        for b in batches:
            for doc_id, start, doc_tokens, wide, raw in zip(*(b.column(k).to_pylist() for k in range(4)), b.column(4)):
                data = np.frombuffer(raw.as_py(), dtype=f"<u{wide}").astype("<u4").tobytes()
                at, n = 0, len(data) // 4
                while at < n:
                    take = min(room, n - at)
                    held.append(((doc_id, start, doc_tokens, data), at, take))
                    at, room = at + take, room - take
                    if not room:
                        offset = 0
                        for segment, a, k in held:
                            rows.append(piece(segment, a, k, sequence, offset))
                            offset += k
                        size += 4 * length
                        sequence, room, held = sequence + 1, length, []
                        if len(rows) > 20_000 or size > 8 << 20:
                            yield batch(rows)
                            rows, size = [], 0
        left, offset, until = length - room, 0, 0  # the rest, cut at powers of two
        for segment, a, k in held:
            while k:
                if not until:
                    sequence, offset, until = sequence + bool(offset), 0, 1 << (left.bit_length() - 1)
                take = min(k, until)
                rows.append(piece(segment, a, take, sequence, offset))
                a, k, left, offset, until = a + take, k - take, left - take, offset + take, until - take
        if rows:
            yield batch(rows)

    rows = tokens.repartitionByRange(shared.partitions(tokens), *order).sortWithinPartitions(*order, "ids")
    return rows.select("doc_id", "start", "doc_tokens", "wide", "ids").mapInArrow(run, PIECES + ", ids binary" * keep_ids)


def op6_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(shared.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)
