import random

import corpus_pipeline
from mnemospark.llm import near_sets as op


def shingle_set(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_kept(rows):
    """Ids that remain: the least of each class under Jaccard 0.8 of all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same, total = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if same >= 0.8 * total:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def edited(r, words, k):
    words = list(words)
    for i in r.sample(range(len(words)), k):
        words[i] = f"new{r.randrange(10**9)}"
    return " ".join(words)


def stage(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(x.doc_id for x in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "").collect())


def test_stage_against_jaccard(spark):
    r = random.Random(2)
    rows = []
    for words, k in [(250, 2), (250, 4), (600, 8), (100, 1), (250, 8), (100, 3)] * 12:
        text = [f"w{r.randrange(3000)}" for _ in range(words)]
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, edited(r, text, k))]
    rows += [(len(rows), "A b"), (len(rows) + 1, "a  B"), (len(rows) + 2, None), (len(rows) + 3, "")]
    want = brute_kept(rows)
    assert 72 < len(want) < len(rows) - 40
    assert stage(spark, rows) == want


def test_tables_against_jaccard(spark, sf):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert stage(spark, rows) == brute_kept(rows)


def test_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(op, "LIMIT", 8)
    r = random.Random(4)
    text = [f"w{i}" for i in range(200)]
    rows = [(k, edited(r, text, r.randrange(9))) for k in range(150)]
    assert stage(spark, rows) == brute_kept(rows)


def test_signatures_name_candidates_before_minhash(spark, monkeypatch):
    r = random.Random(4)
    text = [f"w{r.randrange(3000)}" for _ in range(900)]
    near = " ".join([*text[:-1], "other"])  # within four bits
    rows = [(1, " ".join(text)), (2, near), (3, " ".join(reversed(text)))]
    assert bin(op.op9_simhash.fingerprint(rows[0][1], op.WIDTH) ^ op.op9_simhash.fingerprint(near, op.WIDTH)).count("1") <= op.DISTANCE
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = op.sketches(docs).select("fp", "sim")
    names = {x: op.name(op.shingles(t)) for x, t in rows}
    assert {frozenset(x) for x in op.signed(found).collect()} == {frozenset((names[1], names[2]))}
    monkeypatch.setattr(op, "keys", lambda found: [])  # no MinHash keys: what is left is the method's
    assert stage(spark, rows) == [1, 3]
