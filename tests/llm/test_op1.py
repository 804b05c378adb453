import random

import numpy as np

from mnemospark.llm import op1_decontaminate as op


def brute_score(a, b):
    """Plain Smith-Waterman on words."""
    above, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best


def test_alignment_equals_plain(spark):
    r = random.Random(3)
    for _ in range(60):
        a, b = [r.randrange(5) for _ in range(r.randint(1, 12))], [r.randrange(5) for _ in range(r.randint(1, 20))]
        score, end = op.align(np.array(a), np.array([b]))
        assert score[0] == brute_score(a, b)
        assert brute_score(a, b[: end[0]]) == score[0]


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, op.words_of(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, op.words_of(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.score for r in op.op1_decontamination(spark, sf).collect()}
    want = {}
    for k, item in items:
        bag = set(item)
        for d, words in docs:
            ids = np.array([hash(w) if w in bag else 0 for w in words])
            if 2 * len(item) * op.THRESHOLD <= 2 * int((ids != 0).sum()):
                score = int(op.align(np.array([hash(w) for w in item]), ids[None, :])[0][0])
                if score >= op.THRESHOLD * 2 * len(item):
                    want[d, k] = score
    assert set(got) == set(want) and all(got[p] == want[p] for p in got)
    assert got


def test_edited_copies_and_edges(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    item = [r.choice(vocabulary) for _ in range(40)]
    edited = [w for i, w in enumerate(item) if i % 9 != 4]
    edited[7] = "CHANGED"
    noise = lambda n: [r.choice(vocabulary) for _ in range(n)]
    docs = [(1, " ".join(noise(300) + item + noise(300)), 1), (2, ", ".join(noise(50) + [w.upper() for w in edited] + noise(9)), 1), (3, " ".join(noise(700)), 1), (4, None, 1), (None, " ".join(item), 1), (5, "", 1), (1, " ".join(item), 2), (6, " ".join(noise(90_000) + item), 1)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(9, " ".join(item)), (9, " ".join(item)), (8, None), (7, ""), (6, "w1 w2")], "item_id long, text string")
    got = sorted((str(x.doc_id), x.item_id) for x in op.contaminated(docs, items).collect())
    assert got == sorted([(d, 9) for d in ("1", "1", "2", "6", "None")] * 2)
    assert sorted(x.doc_id for x in op.decontaminate(docs, items).collect()) == [3, 4, 5]
    assert op.contaminated(docs.limit(0), items).count() == 0 and op.contaminated(docs, items.limit(0)).count() == 0


def test_slices(spark, monkeypatch, sf):
    benchmark, docs = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("benchmark", "documents"))
    want = sorted(map(tuple, op.contaminated(docs, benchmark).select("doc_id", "item_id", "score").collect()))
    monkeypatch.setattr(op, "MOST_BYTES", 3000)
    assert len(list(op.slices(benchmark))) > 1
    assert sorted(map(tuple, op.contaminated(docs, benchmark).select("doc_id", "item_id", "score").collect())) == want


def test_edited_copies_above_the_threshold_are_all_found(spark):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    noise = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = {k: noise(n) for k, n in enumerate((16, 25, 40, 59))}
    docs, want = [], []
    for k, item in items.items():
        for rate in (0.15, 0.2, 0.25, 0.3, 0.4):
            for _ in range(12):  # words replaced, left out and put in at random
                edited = []
                for w in item:
                    edit = r.choice("rld") if r.random() < rate else ""
                    edited += {"r": [r.choice(vocabulary)], "l": [], "d": [w, r.choice(vocabulary)], "": [w]}[edit]
                if brute_score(item, edited) >= op.THRESHOLD * 2 * len(item):
                    want.append((len(docs), k))
                docs.append((len(docs), " ".join(noise(50) + edited + noise(50))))
        apart = [x for w in item for x in (w, "CHANGED")][:-1]  # no two neighbours are left
        want.append((len(docs), k))
        docs.append((len(docs), " ".join(noise(50) + apart + noise(50))))
        for step in (3, 4, 5):
            for new in ("CHANGED", "w5"):
                for exact in (False, True):  # an exact copy elsewhere makes the intact n-grams no rarer than the others
                    edited = [new if i % step == step - 1 else w for i, w in enumerate(item)]
                    if brute_score(item, edited) >= op.THRESHOLD * 2 * len(item):
                        want.append((len(docs), k))
                    docs.append((len(docs), " ".join(noise(50) + edited + noise(50))))
                    if exact:
                        want.append((len(docs), k))
                        docs.append((len(docs), " ".join(item)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in items.items()], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in op.contaminated(frame, benchmark).collect()}
    assert len(want) > 150 and set(want) <= got
    assert {x.doc_id for x in op.decontaminate(frame, benchmark).collect()}.isdisjoint(d for d, _ in want)
