import random

import numpy as np
import xxhash

from mnemospark.llm import op9_simhash as op


def brute_fp(text, width=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(rows, distance=4):
    fps = np.array([f for _, f in rows], dtype=np.uint64)
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= distance):
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return [(d, f, ids.get(find(i))) for i, (d, f) in enumerate(rows)]


def key(r):
    return tuple((x is not None, x) for x in r)


def test_query_whole_table(spark, sf):
    rows = [(r.doc_id, brute_fp(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((d, f"{f:016x}", c) for d, f, c in brute_components(rows))
    assert sorted(map(tuple, op.op9_simhash_near_dedup(spark, sf).collect())) == want


def test_links_dense_and_random(spark, monkeypatch):
    monkeypatch.setattr(op, "LIMIT", 40)
    r = random.Random(1)
    center, fps = r.getrandbits(64), {0}
    for _ in range(150):  # a dense ball: hot buckets
        x = center
        for b in r.sample(range(64), r.randint(0, 4)):
            x ^= 1 << b
        fps.add(x)
    for _ in range(200):
        x = r.getrandbits(64)
        fps |= {x, *(x ^ sum(1 << b for b in r.sample(range(64), k)) for k in (3, 4, 5))}
    signed = np.array(sorted(fps), dtype=np.uint64).view(np.int64)
    nodes = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    got = {row.fp: row.root for row in op.components(nodes, 4).collect()}
    rows = [(int(x), int(np.int64(x).view(np.uint64))) for x in signed]
    for d, _, c in brute_components(rows):
        assert got.get(d, d) == c


def test_edges(spark):
    rows = [(7, None, "x"), (3, "", "x"), (None, " \t\n", "x"), (9, "One two three", None), (8, "one TWO three", "y"), (8, "one TWO three", "y"), (1, "É a b c d " * 40000, "z"), (None, "alone in the world of words", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in op.near_duplicates(docs).collect()), key=key)
    want = brute_components([(d, brute_fp(t)) for d, t, _ in rows])
    assert got == sorted(((d, int(np.uint64(f).view(np.int64)), c) for d, f, c in want), key=key)
    assert op.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_with_clashing_and_dotted_names(spark):
    same = "one two three four five six seven"
    docs = spark.createDataFrame([(1, same, 1, 2, 3, 4, 5), (2, same, 1, 2, 3, 4, 5), (1, same, 6, 2, 3, 4, 5), (3, "quite another text that is here", 1, 2, 3, 4, 5)], ["doc_id", "text", "__fp", "_root", "a.b", "_n", "__least"])
    got = op.keep_one(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]
