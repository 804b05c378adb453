"""Token-id files in Simple-8b: word-aligned packing of ids into 64-bit words.

A file is a row of groups, each some documents of about GROUP ids together.  A
group renames its ids by their frequency in it (a rank table is stored), so that
common ids take few bits, and cuts the ranks into blocks of BLOCK.  In a word the
top 4 bits select how many values of how many bits follow (SELECTORS); a value
over MOST bits is an escape: its word has selector 15 and its value stands in the
group's table of escapes.  Offsets of every block's words and values let a reader
decode all blocks at once, or any one block alone.

Layout, little-endian: magic, then per group the header (counts of documents, ids,
ranks, blocks, words, escapes as u64), doc ids i64, null flags u1, lengths u64,
rank table u64, word offsets of blocks u64, escapes u64, words u64.

Defined cases: null or empty text has the end id alone; a null doc_id sorts first
and is kept; rows of equal doc_id each stand on their own, ordered by text; an empty
table gives no file and no row; further columns are ignored; a text is encoded whole, and
one of more than GROUP ids is a group of its own.
"""

from __future__ import annotations

import io
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared, wordcache

MAGIC = b"IDS8B-01"
GROUP, BLOCK, ESCAPE, MOST, CACHE = 1 << 19, 1024, 15, 60, 900_000
#: Values in a word, bits of each, by selector 0 to 13 (14 is free).
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNTS = np.array([n for n, _ in SELECTORS] + [1, 1], dtype=np.int64)
#: Bits of each small value.
_BITS = np.frexp(np.arange(1 << 17, dtype=np.float64))[1].astype(np.uint8)
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _sliding(bits: np.ndarray) -> dict[int, np.ndarray]:
    """The maximum over each place and the n-1 after it along the last axis, for each n of SELECTORS."""
    out, done = {1: bits}, 1
    for n, _ in reversed(SELECTORS[:-1]):
        before = out[done]
        step = n - done
        while step > 0:
            by = min(step, done)
            moved = np.zeros_like(before)
            moved[:, :-by] = before[:, by:]
            before = np.maximum(before, moved)
            step -= by
        out[n], done = before, n
    return out


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Simple-8b words, the word offset of each block (one more at the end), and the escapes."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    grid = np.zeros((blocks, BLOCK + MOST), dtype=np.uint64)
    grid[:, :BLOCK] = np.concatenate([values, np.zeros(blocks * BLOCK - n, np.uint64)]).reshape(blocks, BLOCK)
    if n and int(values.max()) < len(_BITS):
        bits = _BITS[grid]
    else:
        small = grid >> np.uint64(32) == 0
        bits = np.where(small, np.frexp((grid & np.uint64(0xFFFFFFFF)).astype(np.float64))[1], 32 + np.frexp((grid >> np.uint64(32)).astype(np.float64))[1]).astype(np.uint8)
    most = _sliding(bits)
    pick = np.full(grid.shape, ESCAPE, dtype=np.uint8)
    for s in range(len(SELECTORS) - 1, -1, -1):
        count, wide = SELECTORS[s]
        pick[most[count] <= wide] = s
    size = np.full(blocks, BLOCK, dtype=np.int64)
    size[-1:] = n - (blocks - 1) * BLOCK
    at, rows, seen = np.zeros(blocks, dtype=np.int64), np.arange(blocks), []
    while True:  # one word of every block in each turn
        live = at < size
        if not live.any():
            break
        r = rows[live]
        a = at[live]
        seen.append(np.stack([r, a]))
        at[live] = a + COUNTS[pick[r, a]]
    if not seen:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64), np.zeros(0, np.uint64)
    r, a = np.concatenate(seen, axis=1)
    order = np.argsort(r, kind="stable")
    r, a = r[order], a[order]
    chosen = pick[r, a]
    words = np.zeros(len(r), dtype=np.uint64)
    for s, (count, wide) in enumerate(SELECTORS):
        at_s = np.flatnonzero(chosen == s)
        if len(at_s):
            w = np.full(len(at_s), s << 60, dtype=np.uint64)
            for j in range(count):
                w |= grid[r[at_s], a[at_s] + j] << np.uint64(wide * j)
            words[at_s] = w
    far = chosen == ESCAPE
    words[far] = np.uint64(ESCAPE << 60)
    starts = np.searchsorted(r, np.arange(blocks + 1)).astype(np.uint64)
    return words, starts, grid[r[far], a[far]]


def decode(words: np.ndarray, starts: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """All n values back."""
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    pick = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[pick]
    ends = np.cumsum(counts)
    begin = ends - counts
    out = np.zeros(int(ends[-1]), dtype=np.uint64)
    for s, (count, wide) in enumerate(SELECTORS):
        at = np.flatnonzero(pick == s)
        if len(at):
            mask = np.uint64((1 << wide) - 1)
            for j in range(count):
                out[begin[at] + j] = (words[at] >> np.uint64(wide * j)) & mask
    out[begin[pick == ESCAPE]] = escapes
    first = begin[starts[:-1].astype(np.int64)]
    size = np.full(len(first), BLOCK, dtype=np.int64)
    size[-1] = n - (len(first) - 1) * BLOCK
    full = np.append(first[1:], len(out)) - first
    if (full == size).all():
        return out
    place = np.arange(len(out)) - np.repeat(first, full)
    return out[place < np.repeat(size, full)]


def write_group(out, doc_ids: list, ids: list[bytes]) -> int:
    """Append one group; returns its number of ids."""
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    if len(flat) and int(flat.max()) < 1 << 22:  # by counting
        all_times = np.bincount(flat)
        used = np.flatnonzero(all_times)
        times, place = all_times[used], np.zeros(len(all_times), dtype=np.int64)
        place[used] = np.arange(len(used))
    else:
        used, place, times = np.unique(flat, return_inverse=True, return_counts=True)
        flat = np.arange(len(flat))
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(used), dtype=np.uint64)
    rank[order] = np.arange(len(used), dtype=np.uint64)
    words, starts, escapes = encode(rank[place[flat]] if len(flat) else rank)
    out.write(np.array([len(doc_ids), len(flat), len(used), len(starts) - 1, len(words), len(escapes)], dtype="<u8").tobytes())
    out.write(np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes())
    out.write(np.array([d is None for d in doc_ids], dtype="u1").tobytes())
    out.write(np.array([len(x) // 4 for x in ids], dtype="<u8").tobytes())
    for part in (used[order].astype("<u8"), starts, escapes, words):
        out.write(part.astype("<u8").tobytes())
    return len(flat)


def read_groups(src):
    """(doc ids, null flags, lengths, ids) of each group of an open file, one at a time."""
    if src.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token-id file")
    while head := src.read(48):
        docs, n, used, blocks, words, escapes = (int(x) for x in np.frombuffer(head, dtype="<u8"))

        def take(count: int, kind: str = "<u8"):
            return np.frombuffer(src.read(count * np.dtype(kind).itemsize), dtype=kind)

        doc_ids, nulls, lengths, names = take(docs, "<i8"), take(docs, "u1"), take(docs), take(used)
        starts, far, packed = take(blocks + 1), take(escapes), take(words)
        yield doc_ids, nulls, lengths.astype(np.int64), names[decode(packed, starts, far, n).astype(np.int64)].astype("<u4")


def write_token_files(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write id files in ascending id order; returns the manifest (shard, path, n_docs, n_tokens, first_start).

    Shards come from a range partitioning by id.  A task writes a file of its own
    name, so what a lost task has left is in no manifest and is never read.
    """
    spark = docs.sparkSession
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def write(batches):
        from pyspark import TaskContext

        shared.trim(tokenizer)
        tok = wordcache.load(tokenizer, CACHE)
        fs, folder = shared.open_fs(out_dir)
        part = TaskContext.get().partitionId()
        name, out, docs_n, ids_n = f"ids-{part:06d}-{uuid.uuid4().hex}.s8b", None, 0, 0
        keys, ids, held = [], [], 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                x = tok.encode(text.as_py() or "") + end
                keys.append(key)
                ids.append(x)
                held += len(x) // 4
                if held >= GROUP:
                    out = out or _begin(fs, f"{folder}/{name}")
                    ids_n += write_group(out, keys, ids)
                    docs_n += len(keys)
                    keys, ids, held = [], [], 0
        if keys:
            out = out or _begin(fs, f"{folder}/{name}")
            ids_n += write_group(out, keys, ids)
            docs_n += len(keys)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [part], "path": [f"{out_dir}/{name}"], "n_docs": [docs_n], "n_tokens": [ids_n]}, schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(shared.quoted(id_col).cast("long").alias("id"), shared.quoted(text_col).cast("string").alias("text"))
    sorted_rows = rows.repartitionByRange(shared.partitions(rows), F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())
    made = shared.stored(sorted_rows.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long"), "manifest", f"{out_dir}/_manifest")
    # One row per shard of an advisory partition's size, not per document.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("first_start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def _begin(fs, path: str):
    out = fs.open_output_stream(path)
    out.write(MAGIC)
    return out


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Read the shards of a manifest: doc_id, start, n_tokens, ids_crc32 of each document."""

    def read(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, at = shared.open_fs(path)
                with fs.open_input_stream(at, buffer_size=1 << 20) as src:
                    for doc_ids, nulls, lengths, ids in read_groups(io.BufferedReader(_Raw(src), 1 << 20)):
                        ends = np.cumsum(lengths)
                        view = memoryview(ids).cast("B") if len(ids) else b""
                        crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=nulls.astype(bool)), pa.array(base + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        base += int(ends[-1]) if len(ends) else 0

    rows = manifest.select("path", "first_start")
    return rows.repartition(max(1, min(manifest.select("shard").count(), 20_000))).mapInArrow(read, SCHEMA)


class _Raw(io.RawIOBase):
    """A pyarrow stream for io.BufferedReader, whose read(n) returns all n bytes."""

    def __init__(self, src):
        self.src = src

    def readable(self):
        return True

    def readinto(self, b):
        got = self.src.read(len(b))
        b[: len(got)] = got
        return len(got)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = shared.scratch(spark, "token-files")
    return read_token_files(write_token_files(shared.table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"), 2))
