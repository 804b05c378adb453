"""The commands end to end on a small store."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mnemospark.store import Store

T0 = dt.datetime(2024, 1, 1)
T1 = T0 + dt.timedelta(days=40)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("store")))
    s.init(T0)
    rows = [
        ("decision: deploy the search service with spark", "svc:search", "owner", None, 1, ["alias::finder", "topic"], T0, None),
        ("fact: the search service owner is team blue", "svc:search", "owner", None, 2, ["topic", "x1"], T0 + dt.timedelta(days=1), None),
        ("fact: lunch is at noon", None, None, "short-term", 3, ["x1"], T0, T0 + dt.timedelta(days=5)),
        ("fact: lunch is at noon", None, None, "short-term", 4, ["x2"], T0, None),
    ]
    df = spark.createDataFrame(rows, "content string, entity_key string, claim_key string, silo string, arrival int, tags array<string>, observed_at timestamp, expires_at timestamp")
    made = s.remember(df, T0, mode="supersede").collect()
    assert len(made) == 4
    return s


def ids(store, text):
    return store.tables.read("memories").filter(F.col("content").contains(text)).select("memory_id")


def test_remember_supersedes_and_keeps_space(spark, store):
    got = {r.content[:20]: (r.status, r.kind, r.space) for r in store.tables.read("memories").collect()}
    assert got["decision: deploy the"] == ("superseded", "decision", "default")
    assert got["fact: the search ser"] == ("active", "fact", "default")
    assert store.tables.read("links").first().link_type == "supersedes"
    assert {r.silo for r in store.silo_list().collect()} == {"durable", "short-term"}
    assert store.space_list().first().memories == 4


def test_search_pack_and_trace(spark, store):
    q = spark.createDataFrame([(1, "search service owner"), (2, "lunch")], "query_id int, text string")
    got = store.search(q, T0).orderBy("query_id", "rank").collect()
    assert got[0].query_id == 1 and "team blue" in got[0].content and [r.query_id for r in got].count(2) == 2
    lines = [r.line for r in store.pack(q, T0, budget=60).orderBy("order").collect()]
    assert lines and len("\n".join(lines)) <= 60
    assert store.pool_trace(q, T0, cap=1).filter("dropped is not null").count() == 1
    assert {r.query_id for r in store.search(q, T1).collect()} == {1, 2}


def test_lifecycle(spark, store):
    d = store.dream(T1, ["expire", "dedupe"], dry_run=True)
    assert d["expire"].count() == 1 and d["dedupe"].count() == 1
    assert store.tables.read("memories").filter("status = 'expired'").count() == 0
    recall = [("m", T0 + dt.timedelta(hours=k), "retrieved", f"q{k}", 1, 0.9, f"s{k}") for k in range(3)]
    x2 = store.tables.read("memories").filter(F.array_contains("tags", "x2")).first().memory_id
    store.recall_log(spark.createDataFrame([(x2, *r[1:]) for r in recall], "memory_id string, ts timestamp, kind string, query string, rank long, score double, session_id string"))
    assert store.promotion_candidates().first().memory_id == x2
    store.dream(T1, ["promote", "expire"])
    m = {r.memory_id: r for r in store.tables.read("memories").collect()}
    assert m[x2].silo == "durable" and m[x2].accessed_at == T0 + dt.timedelta(hours=2)
    assert sum(r.status == "expired" for r in m.values()) == 1
    store.verify(ids(store, "team blue"), "repo", T1)
    store.forget(ids(store, "team blue"), T1, "wrong")
    r = store.get(ids(store, "team blue")).first()
    assert r.status == "tombstoned" and '"verified_against":"repo"' in r.metadata_json
    assert [e.event_type for e in store.history(ids(store, "team blue")).orderBy("rank").collect()] == ["remembered", "forgotten"]
    assert store.doctor().first().asDict() == {"bad_hash": 0, "bad_status": 0, "bad_confidence": 0, "repeated_ids": 0}
    assert store.stats().first().memories == 4


def test_documents(spark, store):
    c = spark.createDataFrame([("default", "a.md", 0, "alpha beta", "p1"), ("default", "b.md", 0, "alpha beta", "p2"), ("default", "a.md", 1, "gamma", None)], "space string, source_path string, chunk_index int, content string, provenance string")
    store.ingest(c, T0)
    store.ingest(c.filter("source_path = 'a.md' and chunk_index = 0").withColumn("provenance", F.lit("p9")), T1)
    assert store.tables.read("episodes").count() == 3
    got = store.document_get("a.md").collect()
    assert [r.content for r in got] == ["alpha beta", "gamma"] and got[0].provenance == "p9" and got[0].created_at == T0
    assert store.document_duplicates().first().n == 2
    q = spark.createDataFrame([(1, "gamma")], "query_id int, text string")
    assert store.document_search(q).first().id == got[1].id
    store.mark_extracted(spark.createDataFrame([(got[1].id,)], "id string"))
    gone = spark.createDataFrame([(got[1].id,)], "id string")
    assert store.document_prune(gone, "default") == 1 and store.document_prune(gone, "other") == 0
    assert store.document_prune(gone, "default", dry_run=False) == 1 and store.tables.read("episodes").count() == 2


def test_graph_and_queue(spark, store):
    e = [("default", n, "T", n.upper(), "active", [n + "x"], 1) for n in "abc"]
    store.entity_upsert(spark.createDataFrame(e, "space string, entity_id string, entity_type string, canonical_name string, status string, aliases array<string>, seq int"))
    r = [("default", "a", "b", "r", "m1", "active", 0.5, 1), ("default", "b", "c", "r", "m2", "active", 0.5, 1), ("default", "a", "c", "r", "m3", "active", 0.5, 1)]
    store.relationship_upsert(spark.createDataFrame(r, "space string, subject string, object string, rel_type string, memory_id string, status string, confidence double, seq int"))
    assert store.entity_search("BX").first().entity_id == "b"
    seeds = spark.createDataFrame([("a",)], "node string")
    assert store.graph_neighbors(seeds, 1).count() == 3 and store.graph_full().count() == 3
    assert {x.memory_id for x in store.graph_context(seeds, 1).collect()} == {"m1", "m2", "m3"}
    store.entity_merge("b", "a")
    assert store.graph_neighbors(seeds, 1).count() == 1
    store.candidate_submit(spark.createDataFrame([("default", "fact: new thing", "fact"), ("default", "bad", "fact")], "space string, content string, kind string"), T0)
    new = store.candidate_list().filter("content like '%new%'")
    assert store.candidate_decide(new, "approved", T0) == 1 and store.candidate_decide(new, "rejected", T0) == 0
    assert ids(store, "new thing").count() == 1


def test_export_import(spark, store, tmp_path):
    store.export(f"{tmp_path}/a")
    other = Store(spark, f"{tmp_path}/s")
    assert other.load(f"{tmp_path}/a").count() == 0
    key = lambda s: sorted((r.memory_id, r.status, r.content) for r in s.tables.read("memories").collect())
    assert key(other) == key(store)
    with pytest.raises(ValueError):
        other.load(f"{tmp_path}/a")
    store.backup(f"{tmp_path}/b")
    assert spark.read.parquet(f"{tmp_path}/b/memories").count() == len(key(store))
