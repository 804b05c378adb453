"""The relational reports as DataFrame plans; reports.py says in SQL what each must return.

Each takes a Source, whose attributes are the record model's and the base tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import duplicates, graph, integrity, lifecycle, links, rollups
from ..operators.ranking import top_k
from . import reports
from .model import AS_OF, BASE, plan

QUERIES: dict = {}


class Source:
    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf}/{name}.parquet") if name in BASE else plan(f"SELECT * FROM {name}")(self.spark, self.sf)


def frame(f):
    QUERIES[f.__name__] = lambda spark, sf: f(Source(spark, sf))
    return f


def by(*keys):
    return Window.partitionBy(*keys)


def numbered(df: DataFrame, window, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(window).cast("long"))


def visible(m: DataFrame) -> DataFrame:
    return m.filter(lifecycle.visible(F.expr(AS_OF)))


def active(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") == "active")


# --- scans, projection, filters -------------------------------------------------
@frame
def memory_list(t):
    m = active(t.mem).filter(F.col("kind").isin("fact", "decision"))
    out = numbered(m, by("space").orderBy(F.desc("updated_at"), "memory_id"))
    return out.select("memory_id", "space", "silo", "kind", "status", "pinned", F.round("confidence", 6).alias("confidence"), F.substring("content", 1, 80).alias("snippet"), "rank")


@frame
def memory_list_observed_desc(t):
    return numbered(t.mem.filter(F.col("status").isin("active", "superseded")), by("space").orderBy(F.desc("observed_at"), "memory_id")).select("memory_id", "space", "rank")


@frame
def memory_recall_visible(t):
    return visible(active(t.mem)).select("memory_id", "space", "silo")


@frame
def filter_tags_any(t):
    return t.mem.join(t.tags.filter(F.col("tag").isin("topic:7", "part:9", "alias::src4")), "memory_id", "left_semi").select("memory_id", "kind")


@frame
def filter_entity_claim_keys(t):
    named = F.col("entity_key").isin("source:src1", "source:src3") & F.col("claim_key").isin("claim:5", "claim:50", "claim:96")
    return t.mem.filter(named | ((F.col("scope") == "user") & F.col("entity_key").isNull())).select("memory_id", "entity_key", "claim_key")


@frame
def projection_privacy(t):
    shown = F.trim(F.substring("content", 1, 40))
    return t.mem.select("memory_id", F.when(F.col("scope") != "user", F.col("source")).alias("source_ref"), F.lit("").alias("snippet"), F.when(shown != "", shown).otherwise("-").alias("retrieval_text"))


@frame
def point_get(t):
    """Header, active version, companion text, tags, number of events and links of each record."""
    own = t.mem.join(t.versions.select(F.col("version_id").alias("active_version_id"), "memory_id", "version_num", F.col("content_sha256").alias("hash")), ["active_version_id", "memory_id"])
    joined = own.join(t.representations.select(F.col("version_id").alias("active_version_id"), F.col("text").alias("representation")), "active_version_id", "left")
    listed = lambda df, c, sep, name: df.groupBy("memory_id").agg(F.array_join(F.array_sort(F.collect_list(c)), sep).alias(name))
    joined = joined.join(listed(t.tags, F.col("tag"), " ", "tags"), "memory_id", "left").join(listed(t.edges, F.col("edge_id"), ",", "links"), "memory_id", "left")
    joined = joined.join(t.recall.groupBy("memory_id").agg(F.count("*").alias("n_events")), "memory_id", "left")
    return joined.select("memory_id", "status", "version_num", F.col("hash").alias("content_sha256"), "representation", "tags", F.coalesce("n_events", F.lit(0)).alias("n_events"), "links")


@frame
def rerank_projection(t):
    return active(t.mem).select("memory_id", F.substring("content", 1, 512).alias("document"), (F.length("content") > 512).alias("cut"))


@frame
def edge_validity(t):
    began = F.coalesce(F.col("valid_from") <= F.to_timestamp(F.lit("2000-01-01")), F.lit(True))
    lasts = F.coalesce(F.col("valid_to") >= F.to_timestamp(F.lit("1999-06-01")), F.lit(True))
    return active(t.edges).filter(began & lasts).select("edge_id", "subject", "object")


@frame
def edge_support_memory(t):
    live = active(t.mem).filter(F.coalesce(F.col("expires_at") > F.expr(AS_OF), F.lit(True)))
    return active(t.edges).join(live, "memory_id", "left_semi").select("edge_id", "memory_id")


@frame
def graph_status_filter(t):
    return t.entities.filter("status <> 'tombstoned'").groupBy("entity_type", "status").agg(F.count("*").alias("n"))


@frame
def entity_search_substring(t):
    return t.entities.filter("status <> 'tombstoned'").filter(F.lower("canonical_name").contains("00042") | F.lower("entity_id").contains("s7")).select("entity_id", "canonical_name")


# --- joins ----------------------------------------------------------------------
@frame
def join_header_version_tags(t):
    v = t.versions.select(F.col("version_id").alias("active_version_id"), "memory_id", "version_num")
    n = t.tags.groupBy("memory_id").agg(F.count("*").alias("n_tags"))
    return t.mem.join(v, ["active_version_id", "memory_id"]).join(n, "memory_id", "left").select("memory_id", "space", "version_num", "n_tags")


@frame
def anti_missing_projection(t):
    keys = t.mem.filter("entity_key is not null").select("space", "entity_key", "pinned")
    return keys.groupBy("space", "entity_key").agg(F.bool_or("pinned").alias("p")).filter(~F.col("p")).drop("p")


@frame
def orphan_entities(t):
    ends = active(t.edges).select(F.explode(F.array("subject", "object")).alias("entity_id")).distinct()
    return t.entities.join(ends, "entity_id", "left_anti").select("entity_id")


@frame
def dangling_edges(t):
    live = t.entities.filter("status <> 'tombstoned'").select("entity_id")
    end = lambda c: live.select(F.col("entity_id").alias(c), F.lit(False).alias(f"bad_{c}"))
    e = active(t.edges).join(end("subject"), "subject", "left").join(end("object"), "object", "left").fillna(True, ["bad_subject", "bad_object"])
    return e.filter(F.col("bad_subject") | F.col("bad_object")).select("edge_id", "bad_subject", "bad_object")


@frame
def inactive_evidence_edges(t):
    return active(t.edges).select("edge_id", "memory_id").join(t.mem.select("memory_id", "status"), "memory_id", "left").filter(~F.col("status").eqNullSafe("active")).select("edge_id", "memory_id", "status")


@frame
def incident_edges(t):
    half = graph.half_edges(active(t.edges).select("subject", "object", "edge_id", "rel_type")).withColumnRenamed("node", "entity_id")
    return half.join(active(t.entities), "entity_id", "left_semi").select("entity_id", "edge_id", "rel_type", "other")


@frame
def memory_entities(t):
    return t.edges.select("memory_id", F.explode(F.array("subject", "object")).alias("entity_id")).distinct().join(t.entities, "entity_id", "left_semi").select("memory_id", "entity_id")


@frame
def entity_exact_lookup(t):
    asked = t.customer.filter("c_acctbal > 5000").select(F.col("c_name").alias("q")).union(t.supplier.select(F.concat(F.lit("s"), "s_suppkey"))).distinct()
    names = t.entities.select("entity_id", F.explode(F.array("canonical_name", "entity_id")).alias("q"))
    return asked.join(names, "q").select("q", "entity_id")


@frame
def interval_turn_lookup(t):
    turns = rollups.running(t.conversations, "conv_id", "turn", F.length("text"))
    asked = t.conversations.select("conv_id", (100 * F.col("turn")).alias("idx"))
    return asked.join(turns.select("conv_id", "turn", "start", "stop"), "conv_id").filter("idx >= start and idx < stop").select("conv_id", "idx", "turn")


@frame
def cross_space_links(t):
    """Each pair of records of equal content in different spaces, from one array a content."""
    g = t.mem.groupBy("content_sha256").agg(F.array_sort(F.collect_list(F.struct(F.col("memory_id").alias("m"), F.col("space").alias("s")))).alias("g")).filter(F.size(F.array_distinct("g.s")) > 1)
    pairs = g.select(F.posexplode("g").alias("i", "a"), "g").select("a", F.explode(F.expr("slice(g, i + 2, size(g))")).alias("b")).filter("a.s <> b.s")
    return pairs.select(F.col("a.m").alias("src"), F.col("b.m").alias("dst"), F.col("a.s").alias("src_space"), F.col("b.s").alias("dst_space"))


# --- aggregates -----------------------------------------------------------------
@frame
def stats_global(t):
    c = F.col
    return t.mem.agg(
        F.count("*").alias("memories"), F.count_if(c("status") == "active").alias("active"), F.count_distinct("space").alias("spaces"), F.count_distinct("silo").alias("silos"), F.count_if(c("entity_key").isNull()).alias("missing_entity"),
        F.count_if(c("silo") == "short-term").alias("short_term"), F.count_if(c("valid_to") < F.expr(AS_OF)).alias("past_valid_to"), F.count_if("pinned").alias("pinned"),
    )


@frame
def stats_by_status(t):
    return t.mem.groupBy("space").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("active", "superseded", "tombstoned", "expired")])


@frame
def space_list(t):
    m = t.mem.groupBy("space").agg(F.count("*").alias("memories"), F.count_if(F.col("status") == "active").alias("active"))
    names = m.select("space").union(t.spark.createDataFrame([("empty-space",)], "space string")).distinct()
    return names.join(m, "space", "left").join(t.episodes.groupBy("space").agg(F.count("*").alias("episodes")), "space", "left").fillna(0, ["memories", "active", "episodes"])


@frame
def silo_list(t):
    n = t.mem.groupBy("space", "silo").agg(F.count("*").alias("n"))
    return numbered(n, by("space").orderBy(F.when(F.col("silo") == "short-term", 0).when(F.col("silo") == "durable", 1).otherwise(2), "silo"), "position")


@frame
def health_rollup(t):
    groups = active(t.mem).filter("entity_key is not null").groupBy("space", "entity_key", "claim_key").agg(F.count("*").alias("n"))
    m = t.mem.join(groups, ["space", "entity_key", "claim_key"], "left").withColumn("twin", (F.col("status") == "active") & (F.col("n") > 1))
    m = m.join(t.embeddings.select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("v")), "doc_id", "left")
    m = m.join(t.representations.select(F.col("version_id").alias("active_version_id"), F.lit(1).alias("r")), "active_version_id", "left")
    return m.groupBy("space").agg(
        F.count_if(F.col("entity_key").isNull()).alias("missing_keys"), F.count_if("twin").alias("in_duplicate_groups"), F.count_if(F.col("v").isNull()).alias("missing_embedding"),
        F.count_if(F.col("r").isNull()).alias("missing_representation"), F.count_if(F.col("valid_to") < F.expr(AS_OF)).alias("past_valid_to"), F.max(F.when(F.col("v") == 1, F.col("updated_at"))).alias("last_embedding"),
    )


@frame
def duplicate_clusters(t):
    return rollups.duplicate_groups(t.episodes, ["space", "content_sha256"], "id").withColumn("members", F.array_join("members", ","))


@frame
def duplicate_cluster_count(t):
    n = t.episodes.groupBy("space", "content_sha256").agg(F.count("*").alias("n")).filter("n > 1")
    return n.groupBy("space").agg(F.count("*").alias("clusters"), F.sum("n").alias("members"))


@frame
def dedupe_proposals(t):
    out = rollups.dedupe_proposals(active(t.mem), ["space", "content_sha256"])
    return out.select("space", "content_sha256", "canonical", F.array_join("duplicates", ",").alias("duplicates"), "n")


@frame
def promotion_candidates(t):
    hits = t.recall.groupBy(F.col("episode_id").alias("id")).agg(F.count("*").alias("hits"), F.count_distinct("query").alias("queries"), F.max("ts").alias("last_hit"))
    return t.episodes.select("id", "source_path").join(hits.filter("hits >= 3 and queries >= 2"), "id")


@frame
def silo_promotion(t):
    return active(t.mem).filter("silo = 'short-term'").join(rollups.promotable(t.recall), "memory_id").select("memory_id", "sessions")


@frame
def tag_discriminativeness(t):
    return t.tags.groupBy("space", "tag").agg(F.count_distinct("memory_id").alias("df")).filter(F.col("df") <= links.MOST)


@frame
def tag_link_candidates(t):
    return links.tag_links(t.tags).withColumn("confidence", F.round("confidence", 6))


@frame
def tag_link_new_only(t):
    have = t.edges.select(F.col("memory_id").alias("src"), F.concat(F.lit("mem_"), F.lpad((F.col("edge_id") % 997).cast("string"), 9, "0")).alias("dst"))
    return links.new_links(links.tag_links(t.tags), have).select("src", "dst")


@frame
def link_edge_aggregation(t):
    return links.entity_links(links.tag_links(t.tags), t.mem).withColumn("confidence", F.round("confidence", 6))


@frame
def edge_weights(t):
    return active(t.edges).groupBy("subject", "object").agg(F.count("*").alias("weight"))


@frame
def graph_full_nodes(t):
    return active(t.entities).join(rollups.degrees(active(t.edges)).withColumnRenamed("id", "entity_id"), "entity_id").select("entity_id", "canonical_name", "degree")


@frame
def graph_top_degree(t):
    return rollups.top_degree(t.edges, 300)


@frame
def usage_rollup(t):
    u = t.events.groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 3).alias("operation"))
    return u.agg(F.count("*").alias("calls"), F.sum(F.col("event_id") % 10).alias("items"), F.round(F.sum("value"), 2).alias("latency"), F.count_if(F.col("value") < 1).alias("failures"), F.count_if(F.col("value") >= 1).alias("successes"))


@frame
def retrieval_metrics(t):
    place, good = F.col("event_id") % 20, F.col("value") > 100
    hits = t.events.groupBy(F.col("event_type").alias("category"), "user_id").agg(F.min(F.when(good, place + 1)).alias("first_hit"), F.count_if(good & (place < 10)).alias("found"), F.count_if(good).alias("relevant"))
    return rollups.retrieval_metrics(hits)


@frame
def percentile_nearest_rank(t):
    return rollups.nearest_rank(t.events, "event_type", "value", "event_id", {"p50": 0.5, "p95": 0.95})


@frame
def recall_log_touch(t):
    got = F.col("kind") == "retrieved"
    return t.recall.groupBy("memory_id").agg(F.count("*").alias("events"), F.count_if(got).alias("retrieved"), F.max(F.when(got, F.col("ts"))).alias("accessed_at"))


@frame
def document_retrieval_log(t):
    return t.recall.groupBy("query").agg(F.sha2(F.first("query"), 256).alias("query_sha256"), F.count("*").alias("n"), F.min("rank").alias("best_rank"))


@frame
def latest_run(t):
    return t.events.filter("value >= 1").groupBy("event_type").agg(F.max("ts").alias("started_at"))


@frame
def history_counts(t):
    n = t.recall.groupBy("memory_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return n.join(t.mem, "memory_id", "left_semi").withColumn("truncated", F.col("n") > 50)


@frame
def page_totals(t):
    return t.mem.groupBy("space").agg(F.count("*").alias("total")).select("space", "total", F.col("total").alias("last_rank"), (F.col("total") > 10).alias("truncated"))


@frame
def entity_memories_top(t):
    m = active(t.mem).filter("entity_key is not null")
    return top_k(m, "entity_key", [F.desc("pinned"), F.desc("observed_at"), F.desc("updated_at"), F.asc("memory_id")], 5, "rn").select("entity_key", "memory_id", "rn")


# --- lifecycle ------------------------------------------------------------------
@frame
def expire_job(t):
    return active(t.mem).filter(~F.col("pinned") & (F.col("expires_at") <= F.expr(AS_OF))).select("memory_id", F.lit("expired").alias("new_status"), "expires_at")


@frame
def promote_job(t):
    found = active(t.mem).filter("silo = 'short-term'").join(rollups.promotable(t.recall), "memory_id", "left_semi")
    return found.select("memory_id", F.lit("durable").alias("new_silo"), F.lit(None).cast("string").alias("new_expires_at"))


@frame
def forget_transition(t):
    return t.mem.filter("status <> 'tombstoned'").join(t.recall.filter("kind = 'retrieved'"), "memory_id", "left_semi").select("memory_id", F.col("status").alias("old_status"), F.lit("tombstoned").alias("new_status"))


@frame
def document_prune(t):
    return t.episodes.join(t.labels.filter("toxic = 1").select(F.col("doc_id").alias("id")), "id", "left_anti").select("id", "space")


@frame
def mark_extracted(t):
    known = t.labels.select(F.col("doc_id").alias("id"), F.lit("extracted").alias("s"))
    return t.episodes.join(known, "id", "left").select("id", F.coalesce("s", F.lit("pending")).alias("ingest_status"))


@frame
def document_get(t):
    return t.episodes.select("source_path", "id", "chunk_index", "chunk_count", F.length("content").alias("n"))


@frame
def ingest_identity(t):
    w = by("space", "content_sha256", "source_path")
    return t.episodes.select("id", F.when(F.min("id").over(w) == F.col("id"), "inserted").otherwise("skipped").alias("outcome"), F.max("id").over(w).alias("provenance"))


@frame
def candidate_queue(t):
    """The review queue after all decisions: submissions, and decisions in their order, of which the first on a pending one counts."""
    e = t.events
    subs = e.filter("event_type = 'signup'").groupBy(F.col("user_id").alias("candidate_id")).agg(F.min("ts").alias("submitted_at"))
    said = F.when(F.col("event_type") == "error", "quarantined").when(F.col("value") >= 100, "approved").when(F.col("value") < 5, "rejected")
    decisions = e.filter("event_type <> 'signup'").select(F.col("user_id").alias("candidate_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), said.alias("decision"))
    return lifecycle.decided(subs, decisions)


@frame
def entity_upsert(t):
    new = t.customer.groupBy(F.col("c_nationkey").alias("entity_key")).agg(F.max("c_name").alias("canonical_name")).withColumn("entity_type", F.lit(None).cast("string")).withColumn("seq", F.lit(1))
    old = t.nation.select((F.col("n_nationkey") + 3).alias("entity_key"), F.col("n_name").alias("canonical_name"), F.lit("Nation").alias("entity_type"))
    return lifecycle.upsert(old, new, ["entity_key"], ["canonical_name", "entity_type"])


@frame
def relationship_upsert(t):
    return t.edges.groupBy("subject", "rel_type", "object", "memory_id").agg(F.min("edge_id").alias("edge_id"))


@frame
def entity_merge(t):
    out = graph.merge(active(t.edges), "s1", "s0").filter("object = 's0' and subject <> 's0'")
    return out.select("edge_id", "subject", "rel_type", "object", F.when(F.col("outcome").isin("duplicate", "self_loop"), "tombstoned").otherwise("active").alias("status"))


@frame
def verify_freshness(t):
    due = F.when(F.col("updated_at") >= F.to_timestamp(F.lit("2024-01-20")), "fresh").otherwise("verify")
    return t.mem.select("memory_id", F.when((F.col("silo") != "durable") & (F.col("doc_id") % 4 != 0), due).alias("freshness"))


# --- integrity ------------------------------------------------------------------
def spoilt_metadata(c: str):
    return F.expr(reports.METADATA.replace("{0}", c))


@frame
def integrity_active_version(t):
    return integrity.active_versions(t.mem, t.versions)


@frame
def integrity_hash(t):
    return integrity.versions(t.versions)


@frame
def integrity_representations(t):
    return integrity.representations(t.representations, t.versions)


@frame
def integrity_episode_bounds(t):
    e = t.episodes.withColumn("chunk_index", F.when(F.col("id") % 17 == 0, F.col("chunk_count")).otherwise(F.col("chunk_index")))
    e = e.withColumn("content_sha256", F.concat(F.when(F.col("id") % 13 == 0, "x").otherwise(""), "content_sha256")).withColumn("metadata_json", spoilt_metadata("id"))
    return integrity.episodes(e)


@frame
def integrity_memories(t):
    n = lambda k, c, other: F.when(F.col("doc_id") % k == 0, other).otherwise(F.col(c))
    m = t.mem.withColumn("status", n(47, "status", F.lit("lost"))).withColumn("confidence", n(61, "confidence", F.lit(1.5))).withColumn("expires_at", n(67, "expires_at", F.col("observed_at")))
    return integrity.memories(m.withColumn("observed_text", F.expr(reports.STAMPS)).withColumn("metadata_json", spoilt_metadata("doc_id")))


@frame
def integrity_tags(t):
    spoilt = F.when(F.col("tag").like("topic:%3"), F.concat("tag", F.lit(" "))).otherwise(F.col("tag"))
    return integrity.tags(t.tags.select("memory_id", spoilt.alias("tag")).union(t.tags.filter(F.col("tag").like("part:%7")).select("memory_id", "tag")))


@frame
def integrity_spaces(t):
    return t.mem.groupBy("space").agg(F.bool_or(F.col("silo") == "durable").alias("has_default_silo"), F.count_distinct("silo").alias("silos"))


@frame
def integrity_timestamp_grammar(t):
    ts = F.col("ts")
    return t.documents.select("doc_id", F.expr(reports.STAMPS).alias("ts")).select("doc_id", "ts", integrity.valid_timestamp(ts).alias("ok"), integrity.normal_timestamp(ts).alias("normal"))


@frame
def integrity_cross_space_edges(t):
    """Edges whose record lies in a language's space while the subject's nation is of another region."""
    home = F.create_map(F.lit("en"), F.lit(1), F.lit("fr"), F.lit(3))
    where = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), "c_custkey").alias("subject"), "n_regionkey")
    e = active(t.edges).join(t.mem.filter(F.col("space").isin("en", "fr")).select("memory_id", "space"), "memory_id").join(where, "subject")
    return e.filter(home[F.col("space")] != F.col("n_regionkey")).select("edge_id", "space", "n_regionkey")


@frame
def integrity_version_text(t):
    return t.mem.select("memory_id", (F.trim("content") != "").alias("filled"), (F.length("content") <= integrity.MOST_CONTENT).alias("bounded"), F.col("content_sha256").rlike("^[0-9a-f]{64}$").alias("hashed"))


@frame
def integrity_duplicate_keys(t):
    return t.edges.groupBy("subject", "rel_type", "object", "memory_id").agg(F.count("*").alias("n")).filter("n > 1")


# --- evaluation harness ---------------------------------------------------------
@frame
def eval_running_offsets(t):
    return rollups.running(t.conversations, "conv_id", "turn", F.length("text")).select("conv_id", "turn", "start", "stop")


@frame
def eval_context_card(t):
    before = F.lag("text").over(by("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", F.substring(F.concat_ws(" ", before, "text"), 1, 512).alias("card"))


@frame
def eval_event_time(t):
    return t.conversations.select("conv_id", "turn", F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01"), "yyyy-MM-dd") + 86_400 * F.col("conv_id") + F.col("turn")).alias("at"))


@frame
def eval_turn_text(t):
    return t.conversations.select("conv_id", "turn", F.concat("role", F.lit(": "), "text", F.when(F.col("turn") % 3 == 0, F.format_string(" [turn %d]", "turn")).otherwise("")).alias("turn_text"))


@frame
def eval_unambiguous_aliases(t):
    s = t.supplier
    names = s.select(F.lower(F.trim("s_name")).alias("alias"), "s_suppkey").union(s.select(F.concat(F.lit("alias "), F.col("s_suppkey") * F.col("s_suppkey") % 90), "s_suppkey"))
    return names.groupBy("alias").agg(F.min("s_suppkey").alias("entity"), F.count_distinct("s_suppkey").alias("n")).filter("n = 1").drop("n")


@frame
def eval_sample_budget(t):
    """The first 200 turns of the first 50 conversations, by plain limits that run in each task first."""
    turns = t.conversations.filter("role <> 'system'")
    first = turns.select("conv_id").distinct().orderBy("conv_id").limit(50)
    return turns.join(F.broadcast(first), "conv_id", "left_semi").select("conv_id", "turn").orderBy("conv_id", "turn").limit(200)


@frame
def eval_leak_scan(t):
    return t.conversations.select("conv_id", "turn", F.col("text").rlike(r"\[source\]|private/|example\.com").alias("leaks"))


@frame
def token_estimate(t):
    n = F.length("content")
    return t.mem.groupBy("space").agg(F.sum(F.floor((n + 3) / 4)).alias("tokens"), F.max(n).alias("longest"))


# --- further projections, joins and checks ---------------------------------------
@frame
def composite_document_text(t):
    key = F.when(F.trim("entity_key") != "", F.col("entity_key"))
    return active(t.mem).select("memory_id", F.concat_ws("\n\n", key, "content").alias("document"))


@frame
def hook_query(t):
    return t.conversations.filter((F.col("role") == "user") & (F.octet_length("text") >= 20)).select("conv_id", "turn", F.substring("text", 1, 500).alias("q"))


@frame
def external_ranking_join(t):
    first = t.recall.groupBy("memory_id").agg(F.min_by("score", "event_id").alias("distance"))
    return active(t.mem).join(first, "memory_id").select("memory_id", F.round("distance", 6).alias("distance"), "kind")


@frame
def admissions_per_candidate(t):
    each = t.recall.groupBy("memory_id", "query", "kind").agg(F.min("rank").alias("best"))
    return each.groupBy("memory_id").agg(F.count_distinct("query").alias("queries"), F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("sources"), F.min("best").alias("best_rank"))


@frame
def graph_link_proposals(t):
    ends = t.mem.select("memory_id", "space", "entity_key")
    rows = links.tag_links(t.tags).join(ends.toDF("src", "space", "subject"), "src").join(ends.select("memory_id", "entity_key").toDF("dst", "object"), "dst")
    pinned = t.mem.filter("pinned").select("space", F.col("entity_key").alias("subject")).distinct()
    return rows.join(pinned, ["space", "subject"], "left_anti").groupBy("subject", "object").agg(F.min("src").alias("src"), F.count("*").alias("evidence"))


@frame
def contradiction_links(t):
    """Each later record with each earlier one of its claim that says something else."""
    keys = ["space", "entity_key", "claim_key", "kind"]
    m = active(t.mem).filter("entity_key is not null")
    g = m.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("memory_id").alias("m"), F.col("content_sha256").alias("h")))).alias("g")).filter("size(g) > 1")
    pairs = g.select(F.posexplode("g").alias("i", "a"), "g").select("a", F.explode(F.expr("slice(g, 1, i)")).alias("b")).filter("a.h <> b.h")
    return pairs.select(F.col("a.m").alias("src"), F.col("b.m").alias("dst"), F.lit("contradicts").alias("link_type"))


@frame
def write_candidates_entity_kind(t):
    return duplicates.first_others(active(t.mem).filter("entity_key is not null"), ["space", "entity_key", "kind"], "memory_id", 5).select(F.col("memory_id").alias("id"), "other", "k")


@frame
def memory_list_created_desc(t):
    return top_k(t.mem.filter(F.col("status").isin("active", "superseded", "tombstoned")), "silo", [F.desc("observed_at"), F.asc("memory_id")], 100, "rn").select("memory_id", "silo", "rn")


@frame
def space_isolation(t):
    return t.mem.filter(F.col("space").isin("en", "de")).groupBy("space").agg(F.count("*").alias("n"), F.count_if(F.col("scope") == "workspace").alias("workspace"))


@frame
def weighted_degree(t):
    return rollups.degrees(active(t.edges), F.col("confidence")).withColumn("degree", F.round("degree", 4))


@frame
def budget_use_by_category(t):
    n = F.col("n_chars")
    out = t.documents.cube("lang").agg(F.count("*").alias("packs"), F.round(F.avg(F.least(n, F.lit(8000)) / 8000), 6).alias("used"), F.count_if(n > 8000).alias("truncated"))
    return out.withColumn("lang", F.coalesce("lang", F.lit("overall")))


@frame
def ingest_chunk_positions(t):
    w = by("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return t.documents.select("source", "doc_id", F.count("*").over(w).alias("chunk_index"), F.coalesce(F.sum("n_chars").over(w), F.lit(0)).alias("start"))


@frame
def page_ingest_text(t):
    return t.pages.select("page_id", F.length("html").alias("raw_chars"), F.contains("html", F.lit("<title>")).alias("has_title"), F.octet_length("url").alias("url_bytes"))
