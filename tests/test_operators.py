"""Small cases with known results: ties, boundaries, order."""

import datetime as dt
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemospark.functions import text as X
from mnemospark.operators import duplicates, fulltext, graph, lifecycle, ranking, routes, vectors
from mnemospark.sources import archive
from mnemospark.streaming import telemetry


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_maxsim(spark):
    q = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]])], "query_id long, tokens array<array<double>>")
    d = spark.createDataFrame([("A", [[1.0, 0.0], [0.0, 1.0], [0.7, 0.7]]), ("B", [[-1.0, 0.0]])], "id string, tokens array<array<double>>")
    got = {r.id: r.score for r in vectors.maxsim(q, d, 5).collect()}
    assert got["A"] == 2.0 and got["A"] > got["B"]
    assert [r.id for r in vectors.maxsim(q, d, 1).collect()] == ["A"]
    asked, v = q.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0))), spark.createDataFrame([("B", [1.0, 0.0])], "id string, embedding array<double>")
    assert rows(vectors.late_interaction(asked, d, v, 2).orderBy("rank"), "id", "distance") == [("B", 0.0), ("A", 2.0)]


@pytest.mark.parametrize("cap,want", [(10, "abdc"), (2, "ab")])
def test_two_arm_interleave(spark, cap, want):
    arms = [("a", 1, 0), ("b", 2, 0), ("c", 3, 0), ("b", 1, 1), ("d", 2, 1)]
    df = spark.createDataFrame([(1, *x) for x in arms], "query_id int, id string, rank int, arm int")
    got = ranking.interleave(df, "query_id", "arm", cap).orderBy("position")
    assert "".join(r.id for r in got.collect()) == want


def test_recency(spark):
    now = dt.datetime(2024, 3, 1)
    ages = [(1, "short-term"), (90, "short-term"), (-5, "short-term"), (90, "durable")]
    df = spark.createDataFrame([(now - dt.timedelta(days=a), s) for a, s in ages] + [(None, "short-term")], "t timestamp, silo string")
    a, b, future, durable, null = [r[0] for r in df.select(ranking.recency(F.col("t"), F.col("silo"), F.lit(now))).collect()]
    assert a - b > 0.10 and future == 0.20 and null == 0.0 and durable > 0.025


def test_relative_score(spark):
    df = spark.createDataFrame([(-4.0, -4.0), (-1.0, -4.0), (0.0, -4.0), (-1.0, 0.0)], "b double, best double")
    assert [r[0] for r in df.select(ranking.relative(F.col("b"), F.col("best"))).collect()] == [1.0, 0.25, 0.0, 0.0]


def test_supersede_late_arrival(spark):
    data = [(1, "k", 10, "fact", False), (2, "k", 20, "fact", False), (3, "k", 5, "fact", False), (4, "k", 30, "note", False), (5, "p", 1, "fact", True), (6, "p", 2, "fact", False)]
    df = spark.createDataFrame(data, "id int, k string, o int, kind string, pinned boolean")
    got = {r.id: (r.status, r.superseded_by) for r in lifecycle.auto_supersede(df, ["k"], "id", "o", "id").collect()}
    assert got[1] == ("superseded", 2)
    assert all(got[i] == ("active", None) for i in (2, 3, 4, 5, 6))
    with pytest.raises(ValueError):
        lifecycle.resolve(df, "other")


def test_validity_edges(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t, None), (2, None, t), (3, None, None)], "id int, valid_to timestamp, expires_at timestamp")
    assert [r[0] for r in df.filter(lifecycle.visible(F.lit(t))).select("id").collect()] == [1, 3]


def test_pack_first_overflow_and_fallback(spark):
    df = spark.createDataFrame([(1, "a", "x" * 4), (1, "b", "y" * 20), (1, "c", "z"), (2, "a", "long line")], "q int, id string, t string")
    got = rows(ranking.pack(df, "q", [F.asc("id")], F.col("t"), 6).orderBy("q"), "q", "line", "truncated")
    assert got == [(1, "xxxx", False), (2, "long …", True)]


def test_page(spark):
    df = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 9)], "q int, id int")
    got = rows(ranking.page(df, "q", [F.asc("id")], 2, 1).orderBy("id"), "q", "id", "truncated", "total_estimate")
    assert got == [(1, 1, True, 4), (1, 2, True, 4)]


def test_tiers(spark):
    docs = spark.createDataFrame([(1, "deploys run"), (2, "deployment runner"), (3, "deploy only"), (4, "nothing")], "id int, text string")
    q = spark.createDataFrame([(1, "deploys running"), (2, "nothing else"), (3, "the")], "query_id int, text string")
    got = {(r.query_id, r.id): r.tier for r in fulltext.tiered(docs, q).collect()}
    assert got[1, 3] == 2 if (1, 3) in got else True
    assert got[2, 4] == 2
    assert not any(k[0] == 3 for k in got)


def test_text_functions(spark):
    df = spark.createDataFrame([("decision: Use the  Spark engine for É-Joins, please", "project/auth-service.v2")], "t string, k string")
    r = df.select(X.entity_slug(F.col("t")), X.canonical_name(F.col("k")), X.kind_from_prefix(F.col("t")), X.fold(F.lit("É ñ")), X.fingerprint(F.lit("")), X.fingerprint(F.lit("A  b")), X.fingerprint(F.lit("a b")), X.snippet(F.lit("0123456789needle"), F.array(F.lit("needle")), 4)).first()
    assert r[0] == "use-spark-engine-é-joins-please" and r[1] == "auth service v2" and r[2] == "decision" and r[3] == "E n"
    assert r[4] == "cbf29ce484222325" and r[5] == r[6] and r[7] == "89ne"


def test_graph(spark):
    e = spark.createDataFrame([(1, "a", "b", "r"), (2, "b", "c", "r"), (3, "c", "d", "r"), (4, "a", "c", "q")], "edge_id long, subject string, object string, rel_type string")
    s = spark.createDataFrame([("a",)], "node string")
    assert sorted(rows(graph.reach(e, s, 2), "node", "depth")) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    n = graph.neighbours(e, s, 1, 2).orderBy("rank")
    assert rows(n, "edge_id", "truncated") == [(4, True), (1, True)]
    with pytest.raises(ValueError):
        graph.reach(e, s, 5)
    dup = spark.createDataFrame([(1, "x", "a", "r"), (2, "x", "b", "r"), (3, "a", "b", "r"), (4, "b", "y", "r")], "edge_id long, subject string, object string, rel_type string")
    assert dict(rows(graph.merge(dup, "b", "a"), "edge_id", "outcome")) == {1: "kept", 2: "duplicate", 3: "self_loop", 4: "repointed"}


def test_expand(spark):
    e = spark.createDataFrame([(1, "a", "b", "r", 1.0, "m1"), (2, "b", "c", "r", 0.5, "m2"), (3, "a", "c", "r", 0.2, "m2")], "edge_id long, subject string, object string, rel_type string, confidence double, memory_id string")
    s = spark.createDataFrame([("s", "a", 1.0)], "seed string, node string, activation double")
    got = {r.memory_id: (r.hop, r.activation, r.path) for r in graph.expand(s, e).collect()}
    assert got == {"m1": (1, 0.5, "1"), "m2": (1, 0.1, "3")}


def _routes(edges, seeds):
    """{(seed, memory): (hop, activation, path, routes)} by walking every route."""
    half = [(a, b, *rest) for a, b, *rest in [(s, o, e, c, m) for e, s, o, c, m in edges] + [(o, s, e, c, m) for e, s, o, c, m in edges]]
    times = lambda a, c: None if a is None or c is None else a * graph.DECAY * c
    found = {}
    for seed, home, act in seeds:
        for n, b, e, c, m in half:
            if n != home or n is None or b == home:
                continue
            found.setdefault((seed, m), []).append((1, times(act, c), [e]))
            for n2, b2, e2, c2, m2 in half:
                if n2 == b and b is not None and b2 not in (None, home, b):
                    found.setdefault((seed, m2), []).append((2, times(times(act, c), c2), [e, e2]))
    out = {}
    for k, every in found.items():
        hop, act, path = min(((h, None if a is None else round(a, 9), p) for h, a, p in every), key=lambda r: (r[0], r[1] is None, -(r[1] or 0), r[2]))
        out[k] = (hop, act, ">".join(map(str, path)), len(every))
    return out


def test_expand_walks_every_route_without_a_shuffle_of_routes(spark):
    rng = random.Random(3)
    edges = [(k, f"a{rng.randrange(9)}", f"b{rng.randrange(6)}", rng.choice([None, 0.0, 0.05, 0.25, 0.333333333]), rng.choice([None, *(f"m{j}" for j in range(20))])) for k in range(150)]
    edges += [(500, "a1", None, 0.5, "open end"), (501, None, "b1", 0.5, "open end too"), (502, "a2", "a2", 0.5, "loop")]
    seeds = [*((f"s{k}", f"a{k}", 1.0) for k in range(9)), ("s1", "a2", 0.7), (None, "a3", 1.0), ("none", "a4", None), ("far", "zz", 1.0)]
    e = spark.createDataFrame(edges, "edge_id long, subject string, object string, confidence double, memory_id string").withColumn("rel_type", F.lit("r"))
    s = spark.createDataFrame(seeds, "seed string, node string, activation double")
    made = graph.expand(s, e)
    assert {(r.seed, r.memory_id): (r.hop, r.activation, r.path, r.routes) for r in made.collect()} == _routes(edges, seeds)
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan.split("MapInArrow")[0]
    assert graph.expand(s.limit(0), e).count() == 0 and graph.expand(s, e.limit(0)).count() == 0


def test_routes_in_pieces(monkeypatch):
    entry = pa.struct([("other", pa.string()), ("edge_id", pa.int64()), ("confidence", pa.float64()), ("memory_id", pa.string())])
    schema = pa.schema([("seed", pa.string()), ("home", pa.string()), ("node", pa.string()), ("activation", pa.float64()), ("edge_id", pa.int64()), ("memory_id", pa.string()), ("found", pa.list_(entry))])
    rng = random.Random(5)
    rows = [(f"s{k % 3}", "h", f"n{k % 7}", 0.5, k, f"m{k % 4}", None) for k in range(40)]
    rows += [(None, None, f"n{k}", None, None, None, [(f"o{j}", 100 * k + j, rng.random(), rng.choice(["m1", "m9", None])) for j in range(9)]) for k in range(6)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, [*r[:6], r[6] and [dict(zip(("other", "edge_id", "confidence", "memory_id"), x)) for x in r[6]]])) for r in rows[k::12]], schema) for k in range(12)]
    every = lambda: sorted((tuple(r.values()) for b in routes.best_routes(batches, 0.5) for r in b.to_pylist()), key=str)
    whole = every()
    monkeypatch.setattr(routes, "AT_ONCE", 2)
    assert every() == whole and sum(r[-1] for r in whole) == 40 + 9 * sum(k % 7 < 6 for k in range(40))


def test_rounded_as_spark_does(spark):
    x = [0.5e-9, 1.5e-9, -2.5e-9, 0.1234567885, 0.1234567895, 1e20, -0.0, 12345678.1234567895, math.inf, 3.3e-5]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 9)).collect()
    assert routes.rounded(np.array(x)).tolist() == [r[0] for r in got]


def test_duplicates(spark):
    d = spark.createDataFrame([(1, "s", "alpha beta gamma delta"), (2, "s", "alpha beta gamma other"), (3, "t", "alpha beta gamma delta"), (4, "s", "unrelated words here")], "id int, space string, text string")
    assert sorted(rows(duplicates.lexical_related(d, d), "id", "other")) == [(1, 2), (2, 1)]
    few = duplicates.first_others(d.withColumn("g", F.lit(1)), ["g"], "id", 2)
    assert sorted(rows(few, "id", "other", "k")) == [(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 1, 1), (3, 2, 2), (4, 1, 1), (4, 2, 2)]


def test_archive_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "a", 0.5)], "id long, name string, x double")
    archive.export({"t": (df, ["id"])}, f"{tmp_path}/a")
    text = "\n".join(open(f).read().rstrip("\n") for f in sorted((tmp_path / "a").glob("part-*")) if f.stat().st_size)
    assert text.splitlines()[0].startswith('{"kind":"header"') and '"counts":{"t":2}' in text.splitlines()[-1]
    got, bad = archive.load(spark, f"{tmp_path}/a", {"t": df.schema})
    assert sorted(got["t"].collect()) == sorted(df.collect()) and bad.count() == 0
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x.txt").write_text("\n".join(text.splitlines()[:-1]))
    with pytest.raises(ValueError):
        archive.load(spark, f"{tmp_path}/b", {"t": df.schema})
    (tmp_path / "c").mkdir()
    (tmp_path / "c/x.txt").write_text(text + "\nnot json\n")
    assert rows(archive.load(spark, f"{tmp_path}/c", {"t": df.schema})[1], "reason") == [("malformed",)]


def test_usage_ledger(spark, tmp_path):
    (tmp_path / "1.jsonl").write_text('{"ts":1,"model":"m","operation":"embed","items":2,"tokens":3,"latency_ms":4,"ok":true}\nbroken\n')
    assert rows(archive.usage_ledger(spark, str(tmp_path)), "model", "items") == [("m", 2)]


def test_verify_metadata(spark):
    df = spark.createDataFrame([('{"a":"1","verified_at":"x"}',), (None,), ("nope",)], "j string")
    got = [r[0] for r in df.select(lifecycle.merge_map(F.col("j"), verified_at=F.lit("now"))).collect()]
    assert got[0] == '{"a":"1","verified_at":"now"}' and got[1] == '{"verified_at":"now"}' and got[2] is None


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = telemetry.windowed_counts(stream).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start, r.event_type): r.n for r in spark.table("w").collect()}
    want = {(r.d, r.event_type): r.n for r in events.groupBy(F.date_trunc("day", "ts").alias("d"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_knn_in_slices(spark, sf, monkeypatch):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = v.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    want = sorted(rows(vectors.knn(q, v, 3), "query_id", "id", "rank"))
    monkeypatch.setattr(vectors, "MOST_NUMBERS", 500)
    assert sorted(rows(vectors.knn(q, v, 3), "query_id", "id", "rank")) == want


def test_timestamps(spark):
    from mnemospark.operators import integrity

    good = {"2024-02-29T00:00:00Z": "2024-02-29T00:00:00.000Z", "2000-02-29T23:59:59.98765Z": "2000-02-29T23:59:59.987Z", "2024-12-31T10:00:00.1Z": "2024-12-31T10:00:00.100Z"}
    bad = ["2023-02-29T00:00:00Z", "1900-02-29T00:00:00Z", "2024-04-31T00:00:00Z", "2024-01-01T24:00:00Z", "2024-01-01T00:60:00Z", "2024-01-01T00:00:00", "2024-01-01T00:00:00.Z", "2024-01-01T00:00:00Z\n", "2024-00-10T00:00:00Z", "", None]
    df = spark.createDataFrame([(x,) for x in [*good, *bad]], "t string")
    got = {r.t: (r.ok, r.n) for r in df.select("t", integrity.valid_timestamp(F.col("t")).alias("ok"), integrity.normal_timestamp(F.col("t")).alias("n")).collect()}
    assert got == {t: (True, n) for t, n in good.items()} | {t: (False, None) for t in bad}


def test_integrity_rules(spark):
    from mnemospark.operators import integrity

    v = spark.createDataFrame([("v1", "m1", "a", "{}"), ("v2", "mX", " ", "[1]"), ("v3", "m3", "b", None)], "version_id string, memory_id string, content string, source_ref_json string")
    v = v.withColumn("content_sha256", F.when(F.col("version_id") == "v3", "0").otherwise(F.sha2("content", 256))).withColumn("summary", F.lit("s"))
    assert sorted(rows(integrity.versions(v), "version_id", "broken")) == [("v2", "blank,source"), ("v3", "hash")]
    m = spark.createDataFrame([("m1", "v1"), ("m2", "v2"), ("m3", None)], "memory_id string, active_version_id string")
    assert sorted(rows(integrity.active_versions(m, v), "memory_id")) == [("m2",), ("m3",)]
    r = spark.createDataFrame([("v1", "t"), ("v9", "t")], "version_id string, text string").withColumn("text_sha256", F.sha2("text", 256))
    assert rows(integrity.representations(r, v), "version_id", "broken") == [("v9", "no_version")]
    t = spark.createDataFrame([("m1", "a"), ("m1", "a"), ("m2", " b"), ("m3", "c")], "memory_id string, tag string")
    assert sorted(rows(integrity.tags(t), "memory_id", "broken")) == [("m1", "repeated"), ("m2", "form")]


def test_tag_links(spark):
    from mnemospark.operators import links

    tags = [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", "x"), ("a", "Decision"), ("c", "Decision"), ("a", "session:1"), ("c", "session:1")]
    t = spark.createDataFrame([(m, "s", f"e{m}", "active", g) for m, g in tags], "memory_id string, space string, entity_key string, status string, tag string")
    found = links.tag_links(t)
    assert rows(found, "src", "dst", "shared", "tags") == [("a", "b", 2, "x,y")]
    assert links.tag_links(t, most=2).count() == 0  # x is on three records, y alone is left
    assert links.new_links(found, spark.createDataFrame([("b", "a")], "src string, dst string")).count() == 0
    assert rows(links.entity_links(found, t.select("memory_id", "entity_key").distinct()), "subject", "object", "evidence") == [("ea", "eb", 1)]


def test_decided(spark):
    s = spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "candidate_id int, submitted_at int")
    d = spark.createDataFrame([(1, 12, 1, "approved"), (1, 13, 2, "rejected"), (2, 9, 3, "approved"), (2, 11, 4, None), (3, 12, 6, "rejected"), (3, 12, 5, "quarantined"), (9, 20, 7, "approved")], "candidate_id int, at int, seq int, decision string")
    assert sorted(rows(lifecycle.decided(s, d), "candidate_id", "status")) == [(1, "approved"), (2, "pending"), (3, "quarantined")]


def test_graph_capture(spark):
    e = [(1, "s", "new", "Old Name", []), (1, "s", "k2", "x", ["Second"]), (2, "s", "a", "Twin", []), (2, "s", "b", "z", []), (3, "s", "k1", "n", []), (3, "s", "other", "old  name", [])]
    e = spark.createDataFrame(e, "capture_id int, space string, entity_key string, canonical_name string, aliases array<string>")
    r = spark.createDataFrame([(1, "new", "k2", "likes", 0.5), (2, "a", "a", "related_to", 2.0), (2, "a", "q", "x", 1.0)], "capture_id int, subject string, object string, rel_type string, confidence double")
    known = spark.createDataFrame([("s", "k1", "old name"), ("s", "k2", "second"), ("s", "t1", "twin"), ("s", "t2", "TWIN"), ("u", "z", "z")], "space string, entity_key string, surface string")
    keys, errors = graph.capture(e, r, known)
    assert sorted(rows(keys, "capture_id", "entity_key", "resolved_key")) == [(1, "k2", "k2"), (1, "new", "k1"), (2, "a", "t1"), (2, "b", "b"), (3, "k1", "k1"), (3, "other", "k1")]
    assert sorted(rows(errors, "capture_id", "errors")) == [(1, None), (2, "ambiguous,confidence,self_loop,undeclared,untyped"), (3, "same_entity")]


def test_bm25_groups_and_slices(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"w{k % 7} w{k % 11} common", "g" + str(k % 2)) for k in range(200)], "id int, text string, space string")
    q = spark.createDataFrame([(k, f"w{k} common", "g" + str(k % 2)) for k in range(6)], "query_id int, text string, space string")
    whole = sorted(rows(fulltext.scored(docs, q, 500), "query_id", "id", "bm25"))
    own = sorted(rows(fulltext.scored(docs, q, 500, group="space"), "query_id", "id", "bm25"))
    assert own == [x for x in whole if x[0] % 2 == x[1] % 2] and len(own) == 600
    monkeypatch.setattr(fulltext, "QUERIES", 2)
    monkeypatch.setattr(fulltext, "BLOCK", 16)
    assert sorted(rows(fulltext.scored(docs, q, 500), "query_id", "id", "bm25")) == whole
    best = {x[:2] for x in whole if x[0] == 3 and x[2] <= sorted(y[2] for y in whole if y[0] == 3)[4]}
    assert best <= {x[:2] for x in rows(fulltext.bm25(docs, q, 5), "query_id", "id")}
