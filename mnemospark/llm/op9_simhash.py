"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into SEGMENTS = 3 parts.  Of two fingerprints with at
most 4 differing bits, one part differs in at most one bit.  Each fingerprint is
indexed by its parts as they are (3 keys) and by its parts with one bit deleted (64
keys); equal keys meet, and every meeting is verified on all 64 bits.  Equal
fingerprints are one node from the start, so copies never meet each other.

A bucket is compared in blocks and yields the links of a spanning forest of its
verified pairs, never all its pairs; a bucket of over LIMIT fingerprints is dealt out
as pairs of chunks, so that no task holds more than 2 * LIMIT of one bucket.

Defined cases: null or empty text has fingerprint zero and is linked like any other;
a null doc_id is kept and never names a component while the component has another
id; repeated rows are each returned; of rows that tie for the least id of a class keep_one()
keeps any one; a text is fingerprinted whole (some 60 bytes of memory a word); an empty
table gives an empty result; further columns are ignored, or passed through by keep_one(),
whatever their names.

Cost: a bucket holds the fingerprints that agree in 20 or 21 bits, so random meetings are
about 67 * n * n / 2 ** 22 for n distinct fingerprints (as many as the rest of the work, some
10,000 operations a fingerprint, from about n = 600 million on).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

SEGMENTS = [(0, 22), (22, 21), (43, 21)]
LIMIT = 8192


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of the word shingles (repeats included) by XXH64, seed 42."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= width:
        hashes = [digest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[:-width] + 1).tolist()]
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts, ends[width - 1 :].tolist())]
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 16384):
        part = np.frombuffer(b"".join(hashes[k : k + 16384]), dtype=np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp) of each row; fp as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(shared.quoted(id_col).cast("long").alias("doc_id"), shared.quoted(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a, b), those that join two trees."""
    parent: dict[int, int] = {}

    def find(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        if (x := find(x)) != (y := find(y)):
            parent[max(x, y)] = min(x, y)
            keep.append(k)
    return a[keep], b[keep]


def _bucket(fp: np.ndarray, side: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the verified links of one large bucket, by blocks of 512."""
    left, right = (fp, fp) if side[0] == 2 else (fp[side == 0], fp[side == 1])
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    held = none
    for i in range(0, len(left), 512):
        for j in range(i if side[0] == 2 else 0, len(right), 512):
            x, y = left[i : i + 512], right[j : j + 512]
            near = np.argwhere(np.bitwise_count((x[:, None] ^ y[None, :]).view(np.uint64)) <= distance)
            p, q = x[near[:, 0]], y[near[:, 1]]
            held = _forest(np.append(held[0], p[p != q]), np.append(held[1], q[p != q]))
    return held


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) between the distinct fingerprints `fp`: every pair within the distance is
    connected by them, directly or by other pairs within the distance."""
    if distance > 5:
        raise ValueError("three segments with one deleted bit find up to 5 differing bits")
    bit = F.col("bit")
    start = F.when(bit < 22, 0).when(bit < 43, 22).when(bit < 64, 43).otherwise(F.element_at(F.array(*[F.lit(s) for s, _ in SEGMENTS]), F.greatest(bit - 63, F.lit(1))))
    mask = F.when(start == 0, (1 << 22) - 1).otherwise((1 << 21) - 1).cast("long")
    part = F.expr("shiftright(fp, start)").bitwiseAND(F.col("mask"))
    gone = F.when(bit < 64, F.expr("shiftleft(1L, bit - start)")).otherwise(F.lit(0).cast("long"))
    side = F.when(bit < 64, F.expr("shiftright(fp, bit) & 1")).otherwise(F.lit(2)).cast("byte")
    indexed = (
        fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(66))).alias("bit"))
        .withColumn("start", start).withColumn("mask", mask)
        .select("fp", F.expr("shiftleft(cast(bit as long), 40)").bitwiseOR(part.bitwiseAND(F.bitwise_not(gone))).alias("key"), side.alias("side"))
    )
    indexed = shared.stored(indexed, "variants")
    hot = indexed.groupBy("key").count().filter(F.col("count") > LIMIT).select("key", F.ceil(F.col("count") / LIMIT).cast("int").alias("chunks"))
    hot = shared.stored(hot, "hot-keys")
    if hot.isEmpty():
        dealt = indexed.withColumn("cell", F.lit(0))
    else:  # chunk pairs (i, j), i <= j: each fingerprint goes to the pairs its chunk is in
        mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        dealt = (
            indexed.join(hot, "key", "left").withColumn("mine", mine)
            .select("fp", "key", "side", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.expr("transform(sequence(0, chunks - 1), x -> least(x, mine) * chunks + greatest(x, mine))"))).alias("cell"))
        )

    def run(batches):
        held = None
        for b in batches:
            now = [np.asarray(b.column(k)) for k in range(4)]
            if held is not None:
                now = [np.append(x, y) for x, y in zip(held, now)]
            key, cell = now[1], now[3]
            last = (key == key[-1]) & (cell == cell[-1])
            cut = int(np.argmax(last))
            held = [x[cut:] for x in now]
            yield from _emit([x[:cut] for x in now])
        if held is not None:
            yield from _emit(held)

    def _emit(rows):
        fp, key, side, cell = rows
        if not len(fp):
            return
        new = np.append(True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(fp)))
        out_a, out_b = [], []
        for s, n in zip(begin[size > 64].tolist(), size[size > 64].tolist()):
            a, b = _bucket(fp[s : s + n], side[s : s + n], distance)
            out_a.append(a)
            out_b.append(b)
        small = np.repeat(size <= 64, size)
        group = np.cumsum(new)
        for k in range(1, 64):  # all pairs of small buckets, at once
            same = small[:-k] & (group[k:] == group[:-k])
            if not same.any():
                break
            at = np.flatnonzero(same & ((side[k:] != side[:-k]) | (side[k:] == 2)))
            a, b = fp[at], fp[at + k]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= distance
            out_a.append(a[near])
            out_b.append(b[near])
        a, b = np.concatenate(out_a or [fp[:0]]), np.concatenate(out_b or [fp[:0]])
        if len(a):
            a, b = _forest(np.minimum(a, b), np.maximum(a, b))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.select("fp", "key", "side", "cell").repartition("key", "cell").sortWithinPartitions("key", "cell", "fp").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fp, component_id (least doc_id reachable over links) of each row."""
    fps = shared.stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    return shared.lookup(fps, classified(fps, links(fps.select("fp").distinct(), distance)).drop("root"), "fp", fps.count())


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """docs with one row left of each class: one of its least id (any one if it has no id)."""
    fps = shared.stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    return kept(docs, fps, classified(fps, links(fps.select("fp").distinct(), distance)), lambda t: int(np.uint64(fingerprint(t, width)).view(np.int64)), id_col, text_col)


def kept(docs: DataFrame, fps: DataFrame, classes: DataFrame, fp_of, id_col: str, text_col: str) -> DataFrame:
    """docs with one row left of each of classes; fps holds doc_id and fp_of(text) of each row."""
    # Rows that tie as representative of a class: none where ids are unique.
    ties = shared.stored(shared.lookup(fps, classes, "fp", fps.count()).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").count().filter("count > 1").select("root"), "ties")
    at = docs.columns.index(text_col)
    fp, tree, least, many = shared.fresh(docs.columns, "_fp", "_root", "_least", "_n")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([fp_of(t.as_py()) for t in b.column(at)], pa.int64())], names=[*map(str, range(b.num_columns + 1))])

    keyed = classes.select(F.col("fp").alias(fp), F.col("root").alias(tree), F.col("component_id").alias(least), F.col("n").alias(many))
    rows = shared.mapped(docs, run, T.StructField(fp, T.LongType()))
    found = shared.lookup(rows, keyed, fp, fps.count(), many).filter(shared.quoted(id_col).cast("long").eqNullSafe(F.col(least)))
    if not ties.isEmpty():
        ties = ties.withColumnRenamed("root", tree)
        tied = found.join(ties, tree, "left_semi").dropDuplicates([tree])
        found = found.join(ties, tree, "left_anti").unionByName(tied)
    return found.select(*[shared.quoted(c) for c in docs.columns])


def classified(fps: DataFrame, pairs: DataFrame) -> DataFrame:
    """By the links `pairs` (a, b): fp, n (rows with it), root (least fp of its class), component_id (least doc_id of its class)."""
    nodes = shared.stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "nodes")
    root = shared.stored(shared.components(pairs).withColumnRenamed("node", "fp").join(nodes.select("fp", "rep"), "fp"), "roots")
    least = shared.stored(root.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")), "least")
    named = shared.lookup(root.select("fp", "root"), least, "root", root.count())
    return shared.stored(nodes.join(named, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id")), "classes")


def components(nodes: DataFrame, distance: int) -> DataFrame:
    """(fp, root) of each fingerprint that has a link."""
    return shared.components(links(nodes.select("fp"), distance)).withColumnRenamed("node", "fp")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(shared.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
