"""Near-duplicates by word shingles: similarity (Jaccard) of 0.8 and more.

A document is its set of distinct shingles of WIDTH words; equal sets are one node.
First candidates are the links of op9's SimHash index (deletion-variant signatures of
fingerprints over the same shingles, DISTANCE bits): all sets of a fingerprint with the least of
them, and the least ones of two near fingerprints.  At similarity 0.8 fingerprints differ in more bits than such an
index can find, so further candidates meet in the buckets of a MinHash index of BANDS keys of ROWS
values each; a pair of similarity 0.8 shares no key with probability (1 - 0.8^4)^24 = 3e-6, a more
similar one more rarely.  Every candidate of either index is verified on the sets.

Buckets of the same members are one.  First each set goes to its largest bucket alone, in
cells of LIMIT sets, each with the bucket's least set, and is compared with all of its
cell; most groups are one component after that.  Then the buckets whose members are still in
several components, and were not compared whole, are dealt out in chunks and pairs of chunks.
What is connected is not compared again, and links are spanning forests, so large groups give
no square of rows.  Sets are larger than texts: only those in a bucket are made and moved,
found by a filter of BITS bits (of a fixed size, so it is sent to every task; where it is too
full to tell, more sets are moved and dropped in the join).

Defined cases: documents of fewer words are one shingle; null or empty texts have the
empty set, and are copies of each other; a null doc_id never names a class while the
class has another id; of rows that tie for the least id of a class keep_one() keeps any one; a text is
cut into shingles whole (some 100 bytes of memory a word); an empty table gives an empty
result; further columns pass through keep_one(), whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import op9_simhash, shared

WIDTH, BANDS, ROWS, LIMIT, SLICE, BITS, DISTANCE = 5, 24, 4, 128, 256, 1 << 24, 4
_SEEDS = np.random.default_rng(11).integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Distinct XXH64 of the word shingles, ascending."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-WIDTH])]
    return np.unique(np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends[WIDTH - 1 :] or ends[-1:])), dtype=np.uint64))


def name(found: np.ndarray) -> int:
    """A signed long that names the set."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 42)).view(np.int64))


def keys(found: np.ndarray) -> list[int]:
    """The keys of the set in the index; none of the empty set."""
    import xxhash

    if not len(found):
        return []
    least = np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
    for k in range(0, len(found), 2048):
        x = (found[None, k : k + 2048] ^ _SEEDS) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        np.minimum(least, x.min(axis=1), out=least)
    return [int(np.uint64(xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b)).view(np.int64)) for b in range(BANDS)]


def row_hash(id_col: str, text_col: str):
    """A long that names a row by its id and text."""
    return F.xxhash64(F.xxhash64(shared.quoted(text_col).cast("string")), shared.quoted(id_col).cast("long"))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, fp, keys, sim) of each row; row is its row_hash, fp names the set, sim is its SimHash."""

    def run(batches):
        shared.trim()
        for b in batches:
            texts = b.column(2).to_pylist()
            found = [(name(x), keys(x)) for x in map(shingles, texts)]
            sims = np.array([op9_simhash.fingerprint(t, WIDTH) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((x for x, _ in found), pa.int64()), pa.array((x for _, x in found), pa.list_(pa.int64())), pa.array(sims)], names=["doc_id", "row", "fp", "keys", "sim"])

    rows = docs.select(shared.quoted(id_col).cast("long").alias("doc_id"), row_hash(id_col, text_col).alias("row"), shared.quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, fp long, keys array<long>, sim long")


def bits(rows: DataFrame, column: str):
    """A broadcast filter of BITS bits that holds the longs of a column; see may_hold()."""
    spark = rows.sparkSession
    at = F.pmod(column, F.lit(BITS))
    words = rows.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("b")).collect()  # BITS / 64 rows at most
    out = np.zeros(BITS // 64, dtype=np.int64)
    out[[r.w for r in words]] = [r.b for r in words]
    return spark.sparkContext.broadcast(out)


def may_hold(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.mod(values, BITS)
    return (words[at >> 6] >> (at & 63)) & 1 == 1


def named_sets(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(fp, shingles) of the rows whose row_hash is among wanted.row, and of a few others."""
    sent = bits(wanted, "row")

    def run(batches):
        shared.trim()
        for b in batches:
            texts = b.column(1).filter(pa.array(may_hold(sent.value, np.asarray(b.column(0)))))
            for k in range(0, len(texts), SLICE):
                sets = [shingles(t.as_py()) for t in texts.slice(k, SLICE)]
                yield pa.RecordBatch.from_arrays([pa.array(map(name, sets), pa.int64()), pa.array((x.tobytes() for x in sets), pa.binary())], names=["fp", "shingles"])
        shared.trim()

    return docs.select(row_hash(id_col, text_col).alias("row"), shared.quoted(text_col).cast("string").alias("text")).mapInArrow(run, "fp long, shingles binary")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity is 0.8 or more."""
    total = 4 * (len(a) + len(b))
    return 9 * min(len(a), len(b)) >= total and 9 * (len(a) + len(b) - len(np.union1d(a, b))) >= total


def forest(sets: list[np.ndarray], roots: list[int]) -> list[tuple[int, int]]:
    """Verified pairs (places in sets) that join the trees; equal roots are joined from the start."""
    first: dict[int, int] = {}
    parent = [first.setdefault(r, k) for k, r in enumerate(roots)]

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i in range(len(sets)):
        for j in range(i):
            if (x := find(i)) != (y := find(j)) and similar(sets[i], sets[j]):
                parent[x] = y
                out.append((i, j))
    return out


def _verified(dealt: DataFrame) -> DataFrame:
    """Links (a, b) of rows (fp, root, shingles, key, cell) that agree in key and cell."""

    def emit(rows):
        pairs = forest([np.frombuffer(r[2], dtype=np.uint64) for r in rows], [r[1] for r in rows])
        return [(rows[i][0], rows[j][0]) for i, j in pairs]

    def run(batches):
        held, at = [], None
        for b in batches:
            out = []
            for fp, root, found, *now in zip(*((x.as_py() for x in b.column(k)) for k in range(5))):
                if now != at:
                    out += emit(held)
                    held, at = [], now
                held.append((fp, root, found))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])
        out = emit(held)
        held = []
        shared.trim()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])

    return dealt.select("fp", "root", "shingles", "key", "cell").repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(run, "a long, b long").distinct()


def signed(nodes: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of sets by the SimHash index over nodes (fp, sim); no more than sets and links."""
    least = shared.stored(nodes.groupBy("sim").agg(F.min("fp").alias("a"), F.count("*").alias("n")), "set-signatures")
    same = shared.lookup(nodes.select("fp", "sim"), least, "sim", nodes.count(), listed=True).select("a", F.col("fp").alias("b"))
    near = shared.stored(op9_simhash.links(least.select(F.col("sim").alias("fp")), DISTANCE), "set-near")
    ends = least.select("sim", F.col("a").alias("fp"))
    near = near.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return same.filter("a <> b").unionByName(near)


def links(rows: DataFrame, sets_of) -> DataFrame:
    """Links (a, b) between the sets of rows (doc_id, row, fp, keys, sim); sets_of(wanted rows) gives (fp, shingles).
    Every candidate pair of similarity 0.8 is connected by them, directly or by others."""
    nodes = shared.stored(rows.groupBy("fp").agg(F.min("row").alias("row"), F.first("keys").alias("keys"), F.min("sim").alias("sim")), "set-nodes")
    near = shared.stored(signed(nodes), "set-pairs").withColumn("key", F.xxhash64("a", "b"))
    near = near.select(F.explode(F.array("a", "b")).alias("fp"), "key", F.lit(-1).alias("cell"))
    index = shared.stored(nodes.select("fp", F.explode("keys").alias("key")), "set-index")
    members = [F.bit_xor(F.xxhash64("fp", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    buckets = index.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("least"), *members).filter("n > 1").groupBy("n", "least", "h1", "h2").agg(F.min("key").alias("key"))
    buckets = shared.stored(buckets.select("key", "n", "least", F.ceil(F.col("n") / LIMIT).cast("int").alias("chunks")), "set-buckets")
    met = shared.stored(shared.lookup(index, buckets.withColumn("size", F.col("n")), "key", index.count(), listed=True), "set-members")
    wanted = nodes.join(met.select("fp").unionByName(near.select("fp")).distinct(), "fp").select("fp", "row")
    sets = sets_of(wanted).join(wanted.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.first("shingles").alias("shingles"))
    sets = shared.stored(sets, "sets")
    own = met.groupBy("fp").agg(F.max(F.struct("size", "key", "chunks", "least")).alias("b")).select("fp", "b.*")
    own = shared.stored(own.withColumn("cell", F.pmod(F.xxhash64("fp", "key"), F.col("chunks")).cast("int")), "set-first")
    least = own.select(F.col("least").alias("fp"), "key", "cell").distinct()
    first = own.select("fp", "key", "cell").unionByName(least).unionByName(near).distinct().withColumn("root", F.col("fp"))
    found = shared.stored(_verified(first.join(sets, "fp")), "set-links")
    whole = own.filter("chunks = 1").groupBy("key").agg(F.count("*").alias("there"), F.first("size").alias("size"), F.max((F.col("fp") == F.col("least")).cast("int")).alias("has"))
    whole = whole.filter(F.col("there") + 1 - F.col("has") == F.col("size")).select("key")
    roots = shared.components(found).withColumnRenamed("node", "fp")
    open_ = met.join(whole, "key", "left_anti").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    open_ = shared.stored(open_, "set-open")
    split = shared.stored(open_.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("key", "n"), "set-split")
    open_ = open_.withColumn("chunks", F.ceil(F.col("size") / (4 * LIMIT)).cast("int"))  # larger ones: each set goes to all pairs its chunk is in
    mine = F.pmod(F.xxhash64("fp", "key"), F.col("chunks")).cast("int")
    cells = F.explode(F.expr("transform(sequence(0, chunks - 1), x -> least(x, mine) * chunks + greatest(x, mine))"))
    dealt = shared.lookup(open_.withColumn("mine", mine), split, "key", open_.count(), listed=True).select("fp", "root", "key", cells.alias("cell"))
    return found.unionByName(shared.stored(_verified(dealt.join(sets, "fp")), "set-links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row left of each class: one of its least id (any one if it has no id)."""
    rows = shared.stored(sketches(docs, id_col, text_col), "sketches")
    classes = op9_simhash.classified(rows.select("doc_id", "fp"), links(rows, lambda wanted: named_sets(docs, wanted, id_col, text_col)))
    return kept(docs, rows, classes, id_col, text_col)


def kept(docs: DataFrame, rows: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one row left of each class.  Only rows that may have to go are joined with what
    is known of them; the others stay where they are."""
    named = shared.lookup(rows.select("doc_id", "row", "fp"), classes, "fp", rows.count(), listed=True).select("doc_id", "row", "root", "component_id")
    each = shared.stored(named.groupBy("row", "root", "component_id").agg(F.count("*").alias("n"), F.first("doc_id").alias("doc_id")), "set-rows")
    best = each.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("row").alias("best"))
    best = shared.stored(each.groupBy("root").agg(F.count("*").alias("many")).join(best, "root"), "set-best")
    last = shared.lookup(each, best, "root", each.count(), "many", listed=True).withColumn("goes", F.col("row") != F.col("best"))
    last = shared.stored(last.filter("goes or n > 1").select("row", "goes"), "set-verdicts")
    sent = bits(last, "row")
    row, maybe, goes = shared.fresh(docs.columns, "_row", "_maybe", "_goes")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(may_hold(sent.value, np.asarray(b.column(b.num_columns - 1))))], names=[*map(str, range(b.num_columns + 1))])

    marked = shared.mapped(docs.withColumn(row, row_hash(id_col, text_col)), run, T.StructField(maybe, T.BooleanType()))
    columns = [shared.quoted(c) for c in docs.columns]
    some = marked.filter(F.col(maybe)).join(last.select(F.col("row").alias(row), F.col("goes").alias(goes)), row, "left")
    some = shared.stored(some.filter(~F.coalesce(F.col(goes), F.lit(False))), "set-some")
    one = some.filter(F.col(goes).isNotNull()).dropDuplicates([row])
    return marked.filter(~F.col(maybe)).select(columns).union(some.filter(F.col(goes).isNull()).select(columns)).union(one.select(columns))
