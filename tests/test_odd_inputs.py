"""Registered queries against their SQL on odd and on crowded tables."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq

from compare import TABLES, differ
from mnemospark import catalog
from mnemospark.operators import fulltext, graph


def with_tables(tmp_path, sf, **tables):
    """A folder of sf's tables with some of them replaced."""
    for t in TABLES:
        if t in tables:
            pq.write_table(tables[t], f"{tmp_path}/{t}.parquet")
        else:
            os.symlink(f"{sf}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


def equal(spark, name, sf):
    assert differ(catalog.QUERIES[name](spark, sf), catalog.ORACLES[name], sf) is None


def test_query_bundles_of_odd_white_space_and_letters(spark, sf, tmp_path):
    texts = [None, "", "\u00a0Where is the house?\u00a0", "\u3000night owl", "a\x0bb cde\x0bfgh", "\u03a3\u039f\u03a6\u039f\u03a3 x", "\u0130stanbul", "word.\u2028 next", "night owl", "\ttab end\t"]
    rows = [(4 * k + t, t, "user", x) for k, x in enumerate(texts) for t in range(3)] + [(999, None, "user", "no turn here")]
    sf = with_tables(tmp_path, sf, conversations=pa.table(list(map(list, zip(*rows))), schema=pa.schema([("conv_id", pa.int64()), ("turn", pa.int32()), ("role", pa.string()), ("text", pa.string())])))
    equal(spark, "query_bundles", sf)
    equal(spark, "keyword_queries", sf)


def test_entity_mentions_never_sends_the_runs(spark, sf, monkeypatch):
    plan = lambda: catalog.QUERIES["entity_mentions"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    at = plan().split("BroadcastHashJoin [name")
    assert len(at) == 2 and "Inner, BuildRight" in at[1].split("\n")[0]
    monkeypatch.setattr(graph, "SENT", 0)  # as if the names were too many
    assert "SortMergeJoin [name" in plan() and "BroadcastHashJoin [name" not in plan()
    equal(spark, "entity_mentions", sf)


def test_context_equals_brute_force(spark):
    dice = random.Random(5)
    edges = [(f"n{dice.randrange(9)}", f"n{dice.randrange(9)}", f"m{dice.randrange(14)}") for _ in range(16)]
    about = [(f"m{dice.randrange(20)}", f"n{dice.randrange(9)}") for _ in range(25)]
    for depth, limit in [(1, 3), (2, 4), (3, 50)]:
        want = []
        for seed in [f"n{k}" for k in range(9)]:
            near = {seed: 0}
            for hop in range(1, depth + 1):
                near |= {y: hop for s, o, _ in edges for x, y in ((s, o), (o, s)) if near.get(x, 99) < hop and y not in near}
            found = [(0, min(near[s], near[o]), m) for s, o, m in edges if s in near and o in near] + [(1, near[n], m) for m, n in about if n in near]
            best = {m: min(x[:2] for x in found if x[2] == m) for *_, m in found}
            want += [(seed, m, *best[m], k + 1) for k, m in enumerate(sorted(best, key=lambda m: (*best[m], m))[:limit])]
        got = graph.context(spark.createDataFrame(edges, "subject string, object string, memory_id string"), spark.createDataFrame([(f"n{k}",) for k in range(9)], "node string"), spark.createDataFrame(about, "memory_id string, node string"), depth, limit)
        assert sorted(map(tuple, got.select("seed", "memory_id", "arm", "depth", "rank").collect())) == sorted(want)


def test_context_of_a_crowded_node_makes_no_pairs(spark):
    edges = spark.range(20_000).selectExpr("concat('s', id) subject", "'hub' object", "id memory_id")
    about = spark.range(20_000).selectExpr("id + 1000000 memory_id", "'hub' node")
    got = graph.context(edges, edges.selectExpr("subject node"), about, 2, 20)  # 400 million pairs, twice, if joined
    assert got.groupBy("arm").count().collect() == [(0, 400_000)]


def test_many_queries_are_answered_in_one_pass(spark, sf, monkeypatch):
    monkeypatch.setattr(fulltext, "QUERIES", 3)
    monkeypatch.setattr(fulltext, "BLOCK", 16)
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id id", "text", "lang space")
    found = fulltext.scored(docs, docs.filter("id % 20 = 0").selectExpr("id query_id", "text", "space"), 5, group="space")
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    equal(spark, "lexical_duplicates", sf)
