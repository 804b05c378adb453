"""Registered retrieval, fusion, packing, lifecycle, graph and dedup queries, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import duplicates, fulltext, graph, lifecycle, ranking, vectors
from .model import AS_OF, oracle, plan

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Fixed values, as in functions/text.py, for the SQL side.
STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
TOK = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\p{{L}}\p{{N}}_]+')"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return keep


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def items(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return plan(f"SELECT * FROM {name}")(spark, sf)


BM25 = f"""WITH q0 AS (SELECT item_id AS query_id, text, list_distinct({TOK.format('text')}) AS ts FROM benchmark),
qk AS (SELECT query_id, text, ts, list_filter(ts, lambda x: x NOT IN ({STOP})) AS k FROM q0), q AS (SELECT query_id, list_sort(CASE WHEN len(k) > 0 THEN k ELSE ts END) AS terms FROM qk),
qt AS (SELECT query_id, unnest(terms) AS term FROM q), dw AS (SELECT doc_id AS id, text, {TOK.format("coalesce(text, '')")} AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM dw), h AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM dw) x WHERE term IN (SELECT term FROM qt) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM h GROUP BY term),
wt AS (SELECT id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS weight FROM h JOIN df USING (term), st),
s AS (SELECT query_id, id, round(-sum(weight), 9) AS bm25 FROM wt JOIN qt USING (term) GROUP BY query_id, id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25, id) AS rank FROM s) """
SNIP = "substr(d.text, CAST(greatest(coalesce(list_min(list_filter(list_transform(q.terms, lambda t: instr(translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), t)), lambda p: p > 0)), 1) - 81, 0) + 1 AS BIGINT), 160)"


@query("document_search_lexical", BM25 + f", b AS (SELECT query_id, min(bm25) AS best FROM r WHERE rank <= 10 GROUP BY query_id) SELECT r.query_id, r.id, r.rank, round(r.bm25, 6) AS bm25, round(CASE WHEN best < 0 AND r.bm25 < 0 THEN greatest(0, least(1, r.bm25 / best)) ELSE 0 END, 6) AS score, {SNIP} AS snippet FROM r JOIN b USING (query_id) JOIN q USING (query_id) JOIN documents d ON d.doc_id = r.id WHERE r.rank <= 10")
def document_search_lexical(spark, sf):
    return fulltext.search(corpus(spark, sf), items(spark, sf))


@query("lexical_page_two", BM25 + ", w AS (SELECT *, max(rank) OVER (PARTITION BY query_id) > 20 AS more, count(*) OVER (PARTITION BY query_id) AS seen FROM r WHERE rank > 10 AND rank <= 21) SELECT query_id, id, rank, more AS truncated, 10 + least(seen, 10) + CAST(more AS BIGINT) AS total_estimate FROM w WHERE rank <= 20")
def lexical_page_two(spark, sf):
    rows = ranking.page(fulltext.bm25(corpus(spark, sf), items(spark, sf), 21), "query_id", [F.asc("bm25"), F.asc("id")], 10, 10)
    return rows.select("query_id", "id", "rank", "truncated", "total_estimate")


@query("query_terms", BM25 + "SELECT query_id, array_to_string(terms, ' ') AS terms, CAST(len(terms) AS BIGINT) AS n FROM q")
def query_terms(spark, sf):
    t = X.query_terms(F.col("text"))
    return items(spark, sf).select("query_id", F.array_join(t, " ").alias("terms"), F.size(t).cast("long").alias("n"))


@query("corpus_postings", f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents) x GROUP BY term")
def corpus_postings(spark, sf):
    tf = corpus(spark, sf).select("id", F.explode(X.tokens(F.col("text"))).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


STEM = """list_distinct(list_concat([t], list_filter([
 CASE WHEN t LIKE '%ies' AND length(t) > 3 THEN left(t, -3) || 'y' END, CASE WHEN t LIKE '%ied' AND length(t) > 3 THEN left(t, -3) || 'y' END,
 CASE WHEN t LIKE '%ing' AND length(t) >= 7 THEN CASE WHEN substr(t, -4, 1) = substr(t, -5, 1) THEN left(t, -4) ELSE left(t, -3) END END,
 CASE WHEN t LIKE '%ed' AND length(t) >= 6 THEN CASE WHEN substr(t, -3, 1) = substr(t, -4, 1) THEN left(t, -3) ELSE left(t, -2) END END,
 CASE WHEN t LIKE '%es' AND length(t) >= 6 THEN left(t, -2) END, CASE WHEN t LIKE '%s' AND t NOT LIKE '%ss' AND length(rtrim(t, 's')) >= 4 THEN rtrim(t, 's') END,
 CASE WHEN (t LIKE '%ate' OR t LIKE '%ize' OR t LIKE '%ise') AND length(t) >= 5 THEN left(t, -1) END], lambda s: s IS NOT NULL AND length(s) >= 4 AND s <> t)))"""


@query("stem_variants", BM25 + f", x AS (SELECT DISTINCT term AS t FROM qt UNION SELECT unnest(['parties', 'carried', 'stopping', 'planned', 'boxes', 'glasses', 'indicate', 'pass', 'runs', 'deploys', 'ied']) AS t) SELECT t AS term, array_to_string(list_sort(CASE WHEN length(t) < 5 THEN [t] ELSE {STEM} END), ' ') AS variants FROM x")
def stem_variants(spark, sf):
    more = spark.createDataFrame([(w,) for w in "parties carried stopping planned boxes glasses indicate pass runs deploys ied".split()], "term string")
    rows = fulltext.asked(items(spark, sf)).select("term").unionByName(more).distinct()
    return rows.select("term", F.array_join(F.array_sort(X.stems(F.col("term"))), " ").alias("variants"))


TIERED = BM25 + f""", v AS (SELECT query_id, term, unnest(CASE WHEN length(term) < 5 THEN [term] ELSE {re.sub(r'(?<![\w])t(?![\w])', 'term', STEM)} END) AS word FROM qt),
ws AS (SELECT DISTINCT id, unnest(w) AS word FROM dw), a AS (SELECT DISTINCT query_id, id, term, 0 AS tier FROM ws JOIN v USING (word)),
p AS (SELECT DISTINCT query_id, ws.id, term, 1 AS tier FROM ws JOIN qt ON length(term) >= 4 AND regexp_full_match(term, '[a-z0-9]{{4,}}') AND starts_with(ws.word, term)),
m AS (SELECT query_id, id, count(*) FILTER (WHERE tier = 0) AS n0, count(*) AS n1 FROM (SELECT query_id, id, term, min(tier) AS tier FROM (SELECT * FROM a UNION ALL SELECT * FROM p) GROUP BY query_id, id, term) GROUP BY query_id, id),
k AS (SELECT query_id, id, CASE WHEN n0 = len(terms) THEN 0 WHEN n1 = len(terms) THEN 1 END AS tier FROM m JOIN q USING (query_id)),
f AS (SELECT query_id, id, min(tier) AS tier FROM (SELECT query_id, id, tier FROM k WHERE tier IS NOT NULL UNION ALL SELECT query_id, id, 2 FROM s) GROUP BY query_id, id),
c AS (SELECT query_id, count(*) FILTER (WHERE tier = 0) AS t0, count(*) FILTER (WHERE tier = 1) AS t1 FROM f GROUP BY query_id),
z AS (SELECT f.query_id, f.id, CAST(f.tier AS BIGINT) AS tier, coalesce(s.bm25, 0) AS bm25 FROM f JOIN c USING (query_id) LEFT JOIN s ON s.query_id = f.query_id AND s.id = f.id WHERE tier = 0 OR tier = 1 AND t0 < 10 OR tier = 2 AND t0 + t1 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, bm25, id) AS rank FROM z) WHERE rank <= 42""".replace("{{4,}}", "{4,}")


@query("search_tiered_fallback", TIERED)
def search_tiered_fallback(spark, sf):
    return fulltext.tiered(corpus(spark, sf), items(spark, sf))


@query("alias_shingles", "WITH t AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark) SELECT query_id, count(*) AS n, count(DISTINCT g) AS distinct_n FROM (SELECT query_id, unnest(list_concat(w, list_transform(range(1, CAST(len(w) AS BIGINT)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, CAST(len(w) AS BIGINT) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM t) GROUP BY query_id")
def alias_shingles(spark, sf):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    s = items(spark, sf).select("query_id", F.explode(X.shingles(words)).alias("g"))
    return s.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("g").alias("distinct_n"))


# --- vectors --------------------------------------------------------------------
KNN = "WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT q.id AS query_id, e.id, e.label, round(list_distance(q.e, e.e), 9) AS distance FROM e, e q WHERE q.id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM n) "


def vecs(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def vec_queries(spark, sf):
    return vecs(spark, sf).filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")


@query("vector_knn", KNN + "SELECT query_id, id, round(distance, 6) AS distance, round(1 / (1 + greatest(distance, 0)), 6) AS score, rank FROM r WHERE rank <= 10")
def vector_knn(spark, sf):
    near = vectors.knn(vec_queries(spark, sf), vecs(spark, sf), 10)
    return near.select("query_id", "id", F.round("distance", 6).alias("distance"), F.round(vectors.semantic_score(F.col("distance")), 6).alias("score"), "rank")


@query("vector_knn_post_filter", KNN + "SELECT query_id, id, label, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM r WHERE rank <= 40 AND label IN (1, 3, 5)")
def vector_knn_post_filter(spark, sf):
    """The filter comes after the k nearest: fewer rows than asked for may come back."""
    near = vectors.knn(vec_queries(spark, sf), vecs(spark, sf), 40).join(vecs(spark, sf).select("id", "label"), "id").filter(F.col("label").isin(1, 3, 5))
    return ranking.top_k(near.withColumnRenamed("rank", "at"), "query_id", [F.asc("at")], 40).select("query_id", "id", "label", "rank")


MAXSIM = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.label AS query_id, d.label AS id, q.vec_id, max(list_inner_product(q.e, d.e)) AS m FROM e q, e d WHERE q.vec_id % 20 = 0 GROUP BY q.label, d.label, q.vec_id), t AS (SELECT query_id, id, round(sum(m), 6) AS score FROM s GROUP BY query_id, id), x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM t) "


def token_matrices(spark, sf):
    """Token matrices: the embeddings of a label; query matrices: its rows with id divisible by 20."""
    matrix = lambda df, key: df.groupBy(F.col("label").alias(key)).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "embedding"))), lambda x: x["embedding"]).alias("tokens"))
    return matrix(vecs(spark, sf).filter("id % 20 = 0"), "query_id"), matrix(vecs(spark, sf), "id")


@query("maxsim", MAXSIM + "SELECT query_id, id, score, rank FROM x WHERE rank <= 6")
def maxsim(spark, sf):
    return vectors.maxsim(*token_matrices(spark, sf), 6)


@query("late_interaction_order", MAXSIM + ", o AS (SELECT x.query_id, x.id, round(coalesce(list_distance(q.e, v.e), 2.0), 9) AS distance FROM x JOIN e q ON q.vec_id = x.query_id + 20 LEFT JOIN e v ON v.vec_id = x.id AND v.vec_id NOT IN (3, 6) WHERE rank <= 6) SELECT query_id, id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM o")
def late_interaction_order(spark, sf):
    """Labels picked by MaxSim, in the order of single vectors; labels 3 and 6 have none."""
    asked, docs = token_matrices(spark, sf)
    v = vecs(spark, sf).select("id", "embedding")
    asked = asked.join(v.select((F.col("id") - 20).alias("query_id"), "embedding"), "query_id")
    return vectors.late_interaction(asked, docs, v.filter(~F.col("id").isin(3, 6)), 6).withColumn("distance", F.round("distance", 6))


@query("mean_pool_normalise", "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT label, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM e), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY label, i) SELECT label, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m")
def mean_pool_normalise(spark, sf):
    tokens = vecs(spark, sf).groupBy("label").agg(F.collect_list("embedding").alias("t"))
    v = tokens.select("label", vectors.normalised(vectors.mean_pooled(F.col("t"), F.transform("t", lambda _: F.lit(1)))).alias("v"))
    return v.select("label", F.posexplode("v").alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("embedding_consistency", "SELECT label, count(*) AS n, count(DISTINCT len(embedding)) = 1 AS one_size, CAST(min(len(embedding)) AS BIGINT) AS dims FROM embeddings GROUP BY label")
def embedding_consistency(spark, sf):
    return vecs(spark, sf).groupBy("label").agg(F.count("*").alias("n"), (F.count_distinct(F.size("embedding")) == 1).alias("one_size"), F.min(F.size("embedding")).cast("long").alias("dims"))


@query("embedding_backfill", "SELECT d.doc_id AS id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def embedding_backfill(spark, sf):
    return corpus(spark, sf).join(vecs(spark, sf).select("id"), "id", "left_anti").select("id")


# --- scoring, fusion, packing ----------------------------------------------------
@query("recency_scores", f"SELECT memory_id, round(CASE WHEN silo = 'durable' THEN 0.05 * pow(0.5, greatest((epoch_us({AS_OF}) - epoch_us(greatest(updated_at, observed_at))) / 86400000000.0, 0) / 180) ELSE 0.2 * pow(0.5, greatest((epoch_us({AS_OF}) - epoch_us(greatest(updated_at, observed_at))) / 86400000000.0, 0) / 30) END, 6) AS recency FROM mem")
def recency_scores(spark, sf):
    return view(spark, sf, "mem").select("memory_id", F.round(ranking.recency(F.greatest("updated_at", "observed_at"), F.col("silo"), F.expr(AS_OF)), 6).alias("recency"))


@query("score_breakdown", BM25 + f""", p AS (SELECT * FROM r WHERE rank <= 42), b AS (SELECT query_id, min(bm25) AS best FROM p GROUP BY query_id),
x AS (SELECT p.query_id, m.memory_id, m.observed_at, CASE WHEN best < 0 AND bm25 < 0 THEN greatest(0, least(1, bm25 / best)) ELSE 0 END AS fts, greatest(0, least(1, confidence)) * 0.05 + CASE WHEN kind = 'fact' THEN 0.05 ELSE 0 END + CASE WHEN entity_key = 'source:src1' THEN 0.1 ELSE 0 END AS metadata,
 CASE WHEN silo = 'durable' THEN 0.05 * pow(0.5, greatest((epoch_us({AS_OF}) - epoch_us(greatest(updated_at, observed_at))) / 86400000000.0, 0) / 180) ELSE 0.2 * pow(0.5, greatest((epoch_us({AS_OF}) - epoch_us(greatest(updated_at, observed_at))) / 86400000000.0, 0) / 30) END AS recency,
 CASE WHEN scope = 'workspace' THEN 0.03 ELSE 0 END AS scope, CASE WHEN status = 'active' THEN 0.02 ELSE 0 END AS status, CASE WHEN pinned THEN 0.05 ELSE 0 END AS pin, CASE WHEN m.source = 'src2' THEN 0.04 WHEN m.source = 'src3' THEN 0 ELSE 0.02 END AS source_tier
 FROM p JOIN b USING (query_id) JOIN mem m ON m.doc_id = p.id WHERE m.status = 'active'), y AS (SELECT query_id, memory_id, observed_at, round(fts, 6) AS fts, round(metadata, 6) AS metadata, round(recency, 6) AS recency, CAST(round(scope + status + pin + source_tier, 6) AS DOUBLE) AS rest, round(fts + metadata + recency + scope + status + pin + source_tier, 6) AS score FROM x)
SELECT query_id, memory_id, fts, metadata, recency, rest, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, observed_at DESC, memory_id) AS rank FROM y) WHERE rank <= 10""")
def score_breakdown(spark, sf):
    """Pool by BM25, then final scores with all factors."""
    pool = ranking.top_k(fulltext.bm25(corpus(spark, sf), items(spark, sf), ranking.pool_size(10)), "query_id", [F.asc("bm25"), F.asc("id")], ranking.pool_size(10))
    best = pool.groupBy("query_id").agg(F.min("bm25").alias("best"))
    m = view(spark, sf, "mem").filter("status = 'active'")
    rows = pool.join(best, "query_id").join(m, pool["id"] == m["doc_id"])
    kind = F.when(F.col("source") == "src2", "manual").when(F.col("source") == "src3", "synthesis")
    none = F.lit(False)
    rows = rows.withColumn("fts", ranking.relative(F.col("bm25"), F.col("best"))).withColumn("metadata", ranking.metadata(F.col("confidence"), F.col("kind") == "fact", F.col("entity_key") == "source:src1", none, none, none))
    rows = rows.withColumn("recency", ranking.recency(F.greatest("updated_at", "observed_at"), F.col("silo"), F.expr(AS_OF)))
    rest = F.when(F.col("scope") == "workspace", 0.03).otherwise(0.0) + F.when(F.col("status") == "active", 0.02).otherwise(0.0) + F.when(F.col("pinned"), 0.05).otherwise(0.0) + ranking.source_tier(F.coalesce(kind, F.lit("")), F.array().cast("array<string>"))
    rows = rows.withColumn("rest", rest).withColumn("score", F.round(F.col("fts") + F.col("metadata") + F.col("recency") + F.col("rest"), 6))
    out = ranking.top_k(rows, "query_id", [F.desc("score"), F.desc("observed_at"), F.asc("memory_id")], 10)
    return out.select("query_id", "memory_id", *[F.round(c, 6).alias(c) for c in ("fts", "metadata", "recency", "rest")], "score", "rank")


FACTORS = f"""greatest(0, least(1, confidence)) * 0.05 + CASE WHEN kind = 'fact' THEN 0.05 ELSE 0 END + CASE WHEN entity_key = 'source:src1' THEN 0.1 ELSE 0 END + CASE WHEN claim_key IN ('claim:5', 'claim:7') THEN 0.1 ELSE 0 END
 + CASE WHEN doc_id % 5 = 0 THEN 0.05 ELSE 0 END AS metadata, CASE WHEN scope = 'workspace' THEN 0.03 ELSE 0 END + CASE WHEN status = 'active' THEN 0.02 ELSE 0 END + CASE WHEN pinned THEN 0.05 ELSE 0 END AS standing,
 greatest((epoch_us({AS_OF}) - epoch_us(greatest(updated_at, observed_at))) / 86400000000.0, 0) AS age"""


def asked_for():
    return ranking.hits(["fact"], ["source:src1"], ["claim:5", "claim:7"], ["Decision"])


def tagged(spark, sf):
    return view(spark, sf, "mem").withColumn("tags", F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("Decision"))).otherwise(F.array().cast("array<string>")))


@query("semantic_score_breakdown", KNN + f""", m AS (SELECT *, {FACTORS} FROM mem), x AS (SELECT r.query_id, m.memory_id, m.observed_at, round(1 / (1 + greatest(distance, 0)), 6) AS semantic, round(m.metadata, 6) AS metadata,
 round(CASE WHEN silo = 'durable' THEN 0.05 * pow(0.5, age / 180) ELSE 0.2 * pow(0.5, age / 30) END, 6) AS recency, CAST(round(standing + CASE source WHEN 'src2' THEN 0.04 WHEN 'src3' THEN 0 ELSE 0.02 END, 6) AS DOUBLE) AS rest,
 round(1 / (1 + greatest(distance, 0)) + m.metadata + CASE WHEN silo = 'durable' THEN 0.05 * pow(0.5, age / 180) ELSE 0.2 * pow(0.5, age / 30) END + standing + CASE source WHEN 'src2' THEN 0.04 WHEN 'src3' THEN 0 ELSE 0.02 END, 6) AS score FROM r JOIN m ON m.doc_id = r.id WHERE r.rank <= 42 AND m.status = 'active')
SELECT query_id, memory_id, semantic, metadata, recency, rest, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, observed_at DESC, memory_id) AS rank FROM x) WHERE rank <= 10""")
def semantic_score_breakdown(spark, sf):
    """The nearest 42, then final scores with all factors."""
    rows = vectors.knn(vec_queries(spark, sf), vecs(spark, sf), 42).drop("rank").join(tagged(spark, sf).filter("status = 'active'"), F.col("id") == F.col("doc_id"))
    kind = F.when(F.col("source") == "src2", "manual").when(F.col("source") == "src3", "synthesis").otherwise("")
    parts = {
        "semantic": vectors.semantic_score(F.col("distance")), "metadata": ranking.metadata(F.col("confidence"), *asked_for(), F.lit(False)),
        "recency": ranking.recency(F.greatest("updated_at", "observed_at"), F.col("silo"), F.expr(AS_OF)), "rest": ranking.standing(["workspace"]) + ranking.source_tier(kind, F.col("tags")),
    }
    rows = rows.select("query_id", "memory_id", "observed_at", *[v.alias(k) for k, v in parts.items()]).withColumn("score", F.round(sum((F.col(k) for k in parts), F.lit(0.0)), 6))
    out = ranking.top_k(rows, "query_id", [F.desc("score"), F.desc("observed_at"), F.asc("memory_id")], 10)
    return out.select("query_id", "memory_id", *[F.round(k, 6).alias(k) for k in parts], "score", "rank")


@query("pool_tiebreak", BM25 + f", m AS (SELECT *, {FACTORS} FROM mem), x AS (SELECT s.query_id, m.memory_id, m.observed_at, s.bm25, round(m.metadata + standing + CASE WHEN silo = 'durable' THEN 0.05 * greatest(0, 1 - age / 360) ELSE 0.2 * greatest(0, 1 - age / 60) END, 9) AS tiebreak FROM s JOIN m ON m.doc_id = s.id) SELECT query_id, memory_id, round(bm25, 6) AS bm25, round(tiebreak, 6) AS tiebreak, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25, tiebreak DESC, observed_at DESC, memory_id) AS rank FROM x) WHERE rank <= 42")
def pool_tiebreak(spark, sf):
    """Who gets into the pool when relevance ties: the better known, the more recent."""
    rows = fulltext.bm25(corpus(spark, sf), items(spark, sf), 42).join(tagged(spark, sf), F.col("id") == F.col("doc_id"))
    by = ranking.tiebreak(F.col("confidence"), asked_for(), F.greatest("updated_at", "observed_at"), F.col("silo"), F.expr(AS_OF), ["workspace"])
    out = ranking.top_k(rows.withColumn("tiebreak", F.round(by, 9)), "query_id", [F.asc("bm25"), F.desc("tiebreak"), F.desc("observed_at"), F.asc("memory_id")], 42)
    return out.select("query_id", "memory_id", F.round("bm25", 6).alias("bm25"), F.round("tiebreak", 6).alias("tiebreak"), "rank")


SOURCED = BM25.replace("coalesce(text, '')", "concat_ws(' ', text, source)").replace("(translate(text, 'ABC", "(translate(text || ' src1', 'ABC")


@query("lexical_with_source", SOURCED + "SELECT query_id, id, rank, round(bm25, 6) AS bm25 FROM r WHERE rank <= 10")
def lexical_with_source(spark, sf):
    """Relevance over texts with their sources: an index of its own, so sources never change plain relevance."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(" ", "text", "source").alias("text"))
    asked = items(spark, sf).withColumn("text", F.concat("text", F.lit(" src1")))
    return ranking.top_k(fulltext.bm25(docs, asked, 10), "query_id", [F.asc("bm25"), F.asc("id")], 10).select("query_id", "id", "rank", F.round("bm25", 6).alias("bm25"))


ARMS = BM25 + ", v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT b.item_id AS query_id, v.id, row_number() OVER (PARTITION BY b.item_id ORDER BY round(list_distance(q.e, v.e), 9), v.id) AS rank FROM benchmark b JOIN v q ON q.id = b.item_id, v), l AS (SELECT query_id, id, rank FROM r WHERE rank <= 42), a AS (SELECT query_id, id, rank FROM n WHERE rank <= 42) "


def arms(spark, sf):
    lexical = ranking.top_k(fulltext.bm25(corpus(spark, sf), items(spark, sf), 42), "query_id", [F.asc("bm25"), F.asc("id")], 42).select("query_id", "id", "rank")
    q = items(spark, sf).join(vecs(spark, sf), F.col("query_id") == F.col("id")).select("query_id", "embedding")
    return lexical, vectors.knn(q, vecs(spark, sf), 42).select("query_id", "id", "rank")


@query("hybrid_rrf", ARMS + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score, CASE WHEN count(DISTINCT arm) = 2 THEN 'hybrid' ELSE min(arm) END AS match_type FROM (SELECT *, 'lexical' AS arm FROM l UNION ALL SELECT *, 'semantic' FROM a) GROUP BY query_id, id)) WHERE rank <= 10")
def hybrid_rrf(spark, sf):
    lexical, semantic = arms(spark, sf)
    return ranking.rrf({"lexical": lexical, "semantic": semantic}, 10)


@query("merge_rerank_pools", ARMS + "SELECT query_id, id, rank, arm, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, arm, id) AS position FROM (SELECT query_id, id, min(rank) AS rank, arg_min(arm, rank * 2 + arm) AS arm FROM (SELECT *, 0 AS arm FROM a UNION ALL SELECT *, 1 FROM l) GROUP BY query_id, id)) WHERE position <= 16")
def merge_rerank_pools(spark, sf):
    """Nearest-first interleave of the two arms, each id once."""
    lexical, semantic = arms(spark, sf)
    return ranking.interleave(semantic.withColumn("arm", F.lit(0)).unionByName(lexical.withColumn("arm", F.lit(1))), "query_id", "arm", 16)


@query("round_robin_pack", BM25 + "SELECT lang, id, rank, query_index, position FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY rank, query_index, id) AS position FROM (SELECT lang, id, min(rank) AS rank, arg_min(query_index, rank * 100000 + query_index) AS query_index FROM (SELECT d.lang, r.id, r.rank, r.query_id AS query_index FROM r JOIN documents d ON d.doc_id = r.id WHERE r.rank <= 20) GROUP BY lang, id)) WHERE position <= 50")
def round_robin_pack(spark, sf):
    best = ranking.top_k(fulltext.bm25(corpus(spark, sf), items(spark, sf), 20), "query_id", [F.asc("bm25"), F.asc("id")], 20)
    lists = best.join(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang"), "id").select("lang", "id", "rank", F.col("query_id").alias("query_index"))
    return ranking.interleave(lists, "lang", "query_index", 50)


@query("pack_char_budget", "WITH l AS (SELECT space, memory_id, pinned, '- (' || kind || ') ' || substr(trim(regexp_replace(content, '\\s+', ' ', 'g')), 1, 200) AS line FROM mem WHERE status = 'active'), u AS (SELECT *, row_number() OVER w AS position, CAST(sum(length(line) + 1) OVER (PARTITION BY space ORDER BY pinned DESC, memory_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM l WINDOW w AS (PARTITION BY space ORDER BY pinned DESC, memory_id)) SELECT space, memory_id, position, used, CASE WHEN used <= 2000 THEN line ELSE substr(line, 1, 1999) || '…' END AS line, used > 2000 AS truncated FROM u WHERE used <= 2000 OR position = 1")
def pack_char_budget(spark, sf):
    m = view(spark, sf, "mem").filter("status = 'active'")
    line = F.concat(F.lit("- ("), "kind", F.lit(") "), F.substring(X.collapse(F.col("content")), 1, 200))
    return ranking.pack(m, "space", [F.desc("pinned"), F.asc("memory_id")], line, 2000).select("space", "memory_id", "position", "used", "line", "truncated")


@query("pack_byte_budget_first_cut", "WITH l AS (SELECT space, memory_id, content AS line FROM mem WHERE status = 'active'), u AS (SELECT *, row_number() OVER (PARTITION BY space ORDER BY strlen(line) DESC, memory_id) AS position, CAST(sum(strlen(line) + 1) OVER (PARTITION BY space ORDER BY strlen(line) DESC, memory_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM l) SELECT space, memory_id, position, CASE WHEN used <= 500 THEN line ELSE substr(line, 1, 499) || '…' END AS line, used > 500 AS truncated FROM u WHERE used <= 500 OR position = 1")
def pack_byte_budget_first_cut(spark, sf):
    m = view(spark, sf, "mem").filter("status = 'active'")
    return ranking.pack(m, "space", [F.desc(F.octet_length("content")), F.asc("memory_id")], F.col("content"), 500, "bytes").select("space", "memory_id", "position", "line", "truncated")


@query("min_score_gate", BM25 + ", g AS (SELECT query_id FROM r GROUP BY query_id HAVING min(bm25) <= -40) SELECT r.query_id, r.id, r.rank FROM r JOIN g USING (query_id) WHERE rank <= 5")
def min_score_gate(spark, sf):
    """A query whose best score misses the gate gets nothing."""
    best = ranking.top_k(fulltext.bm25(corpus(spark, sf), items(spark, sf), 5), "query_id", [F.asc("bm25"), F.asc("id")], 5)
    return best.join(best.groupBy("query_id").agg(F.min("bm25").alias("top")).filter("top <= -40"), "query_id", "left_semi").select("query_id", "id", "rank")


# --- lifecycle -------------------------------------------------------------------
W2 = "WITH o AS (SELECT o_orderkey AS id, o_custkey AS k, o_orderdate AS d, o_orderpriority LIKE '1%' AS pinned, CASE WHEN o_orderstatus = 'P' THEN 'note' ELSE 'fact' END AS kind FROM orders), f AS (SELECT a.id, b.id AS by_id, row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS n FROM o a JOIN o b ON a.k = b.k AND b.id > a.id AND b.d > a.d AND b.kind = 'fact' WHERE NOT a.pinned) "


def orders(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("d"), F.col("o_orderpriority").startswith("1").alias("pinned"), F.when(F.col("o_orderstatus") == "P", "note").otherwise("fact").alias("kind"))


@query("auto_supersede", W2 + "SELECT o.id, CASE WHEN f.by_id IS NULL THEN 'active' ELSE 'superseded' END AS status, f.by_id AS superseded_by FROM o LEFT JOIN f ON f.id = o.id AND f.n = 1")
def auto_supersede(spark, sf):
    return lifecycle.auto_supersede(orders(spark, sf), ["k"], "id", "d", "id").select("id", "status", "superseded_by")


@query("write_mode_conflict", W2 + "SELECT o.id, 'active' AS status, f.by_id AS superseded_by, 'contradicts' AS link_type FROM o JOIN f ON f.id = o.id AND f.n = 1")
def write_mode_conflict(spark, sf):
    rows = lifecycle.resolve(lifecycle.auto_supersede(orders(spark, sf), ["k"], "id", "d", "id"), "conflict")
    return rows.filter("link_type is not null").select("id", "status", "superseded_by", "link_type")


@query("validity_filter", f"SELECT memory_id FROM mem WHERE (valid_to IS NULL OR valid_to >= {AS_OF}) AND (expires_at IS NULL OR expires_at > {AS_OF})")
def validity_filter(spark, sf):
    return view(spark, sf, "mem").filter(lifecycle.visible(F.expr(AS_OF))).select("memory_id")


@query("entity_upsert_merge", "WITH o AS (SELECT c_nationkey + 3 AS k, min(c_name) AS name, min(c_mktsegment) AS seg FROM customer GROUP BY c_nationkey), n AS (SELECT s_nationkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) AS r FROM supplier) SELECT coalesce(o.k, n.k) AS k, coalesce(n.name, o.name) AS name, o.seg FROM o FULL OUTER JOIN (SELECT * FROM n WHERE r = 1) n ON n.k = o.k")
def entity_upsert_merge(spark, sf):
    c = read(spark, sf, "customer").groupBy((F.col("c_nationkey") + 3).alias("k")).agg(F.min("c_name").alias("name"), F.min("c_mktsegment").alias("seg"))
    s = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"), F.lit(None).cast("string").alias("seg"), F.col("s_suppkey").alias("seq"))
    return lifecycle.upsert(c, s, ["k"], ["name", "seg"])


# --- graph -----------------------------------------------------------------------
NEAR = """WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS subject, 'r' || n_regionkey AS object, 'in' AS rel_type, n_nationkey AS edge_id FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'of', 1000 + s_suppkey FROM supplier),
h AS (SELECT DISTINCT subject AS node, object AS other FROM e UNION SELECT object, subject FROM e), s AS (SELECT 's' || s_suppkey AS seed FROM supplier),
b AS (SELECT seed, seed AS node, 0 AS depth FROM s UNION SELECT b.seed, h.other, b.depth + 1 FROM b JOIN h ON h.node = b.node WHERE b.depth < 3), m AS (SELECT seed, node, min(depth) AS depth FROM b GROUP BY seed, node) """


def small_graph(spark, sf):
    n = read(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("subject"), F.concat(F.lit("r"), "n_regionkey").alias("object"), F.lit("in").alias("rel_type"), F.col("n_nationkey").cast("long").alias("edge_id"))
    s = read(spark, sf, "supplier")
    edges = n.unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("subject"), F.concat(F.lit("n"), "s_nationkey").alias("object"), F.lit("of").alias("rel_type"), (1000 + F.col("s_suppkey")).alias("edge_id")))
    return edges, s.select(F.concat(F.lit("s"), "s_suppkey").alias("node"))


@query("graph_reach", NEAR + "SELECT seed, node, CAST(depth AS BIGINT) AS depth FROM m")
def graph_reach(spark, sf):
    return graph.reach(*small_graph(spark, sf), 3).withColumn("depth", F.col("depth").cast("long"))


@query("graph_neighbours", NEAR + ", i AS (SELECT a.seed, e.*, CAST(least(a.depth, c.depth) AS BIGINT) AS min_depth, CAST(greatest(a.depth, c.depth) AS BIGINT) AS max_depth FROM e JOIN m a ON a.node = e.subject JOIN m c ON c.node = e.object AND c.seed = a.seed), k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY min_depth, max_depth, rel_type, edge_id) AS rank, count(*) OVER (PARTITION BY seed) > 20 AS truncated FROM i) SELECT seed, CAST(edge_id AS BIGINT) AS edge_id, subject, object, rel_type, min_depth, max_depth, rank, truncated FROM k WHERE rank <= 20")
def graph_neighbours(spark, sf):
    return graph.neighbours(*small_graph(spark, sf), 3, 20)


@query("evidence_expansion", """WITH e AS (SELECT * FROM edges WHERE status = 'active' AND rel_type = 'rel_R'), h AS (SELECT subject AS node, object AS other, edge_id, rel_type, confidence, memory_id FROM e UNION ALL SELECT object, subject, edge_id, rel_type, confidence, memory_id FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY rel_type, other, edge_id) AS n FROM h), s AS (SELECT entity_id AS seed FROM entities WHERE entity_type = 'Customer' AND status = 'active'),
a AS (SELECT seed, other AS node, 0.5 * confidence AS act, edge_id, memory_id FROM s JOIN k ON k.node = s.seed WHERE n <= 200),
b0 AS (SELECT a.seed, h.other, a.act * 0.5 * h.confidence AS act, CAST(a.edge_id AS VARCHAR) || '>' || h.edge_id AS path, a.edge_id AS e1, h.edge_id AS e2, h.memory_id, h.n FROM a JOIN k h ON h.node = a.node WHERE h.other <> a.seed AND h.n <= 200),
r AS (SELECT seed, memory_id, 1 AS hop, round(act, 9) AS act, edge_id AS e1, 0 AS e2, CAST(edge_id AS VARCHAR) AS path FROM a UNION ALL SELECT seed, memory_id, 2, round(act, 9), e1, e2, path FROM b0 WHERE n <= 200),
o AS (SELECT *, row_number() OVER (PARTITION BY seed, memory_id ORDER BY hop, act DESC, e1, e2) AS k, count(*) OVER (PARTITION BY seed, memory_id) AS routes FROM r) SELECT seed, memory_id, CAST(hop AS BIGINT) AS hop, round(act, 6) AS activation, path, routes FROM o WHERE k = 1""")
def evidence_expansion(spark, sf):
    edges = view(spark, sf, "edges").filter("status = 'active' and rel_type = 'rel_R'").select("edge_id", "subject", "object", "rel_type", "confidence", "memory_id")
    seeds = view(spark, sf, "entities").filter("entity_type = 'Customer' and status = 'active'").select(F.col("entity_id").alias("seed"), F.col("entity_id").alias("node"), F.lit(1.0).alias("activation"))
    return graph.expand(seeds, edges).withColumn("activation", F.round("activation", 6))


@query("entity_merge_outcomes", "WITH m AS (SELECT edge_id, rel_type, subject = 's1' OR object = 's1' AS moved, CASE WHEN subject = 's1' THEN 's0' ELSE subject END AS subject, CASE WHEN object = 's1' THEN 's0' ELSE object END AS object FROM edges), k AS (SELECT *, row_number() OVER (PARTITION BY subject, rel_type, object ORDER BY moved, edge_id) AS n FROM m) SELECT edge_id, subject, object, CASE WHEN moved AND subject = object THEN 'self_loop' WHEN moved AND n > 1 THEN 'duplicate' WHEN moved THEN 'repointed' ELSE 'kept' END AS outcome FROM k")
def entity_merge_outcomes(spark, sf):
    return graph.merge(view(spark, sf, "edges"), "s1", "s0").select("edge_id", "subject", "object", "outcome")


@query("orphan_attachment", "WITH o AS (SELECT p_partkey AS node, unnest(string_split(p_name || ' ' || p_type, ' ')) AS t FROM part), a AS (SELECT DISTINCT p_brand AS node, unnest(string_split(p_name || ' ' || p_type, ' ')) AS t FROM part), s AS (SELECT o.node AS orphan, a.node AS anchor, count(*) AS overlap FROM o JOIN a USING (t) GROUP BY o.node, a.node) SELECT orphan, anchor, overlap, CAST(0.15 AS DOUBLE) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY orphan ORDER BY overlap DESC, anchor) AS k FROM s) WHERE k = 1")
def orphan_attachment(spark, sf):
    p = read(spark, sf, "part").withColumn("tokens", F.split(F.concat_ws(" ", "p_name", "p_type"), " "))
    anchors = p.select(F.col("p_brand").alias("node"), F.explode("tokens").alias("t")).groupBy("node").agg(F.collect_set("t").alias("tokens"))
    return graph.attach_orphans(p.select(F.col("p_partkey").alias("node"), "tokens"), anchors)


CAPTURES = """WITH en AS (SELECT o_orderkey AS c, 'c' || o_custkey AS k, 'buyer ' || o_custkey AS name FROM orders UNION ALL SELECT l_orderkey, CASE WHEN l_linenumber = 7 THEN 's' || l_suppkey ELSE 'new:' || l_suppkey END, 'supplier ' || l_suppkey FROM lineitem),
sf AS (SELECT 's' || s_suppkey AS key, 'supplier ' || s_suppkey AS surface FROM supplier UNION SELECT 'twin' || s_suppkey, 'supplier ' || s_suppkey FROM supplier WHERE s_suppkey % 40 = 0),
g AS (SELECT c, k, any_value(name) AS name, count(*) AS times FROM en GROUP BY c, k), h AS (SELECT g.*, count(sf.key) AS n, min(sf.key) AS found, EXISTS (SELECT 1 FROM sf x WHERE x.key = g.k) AS exact FROM g LEFT JOIN sf ON sf.surface = g.name GROUP BY ALL),
z AS (SELECT *, CASE WHEN exact THEN k ELSE coalesce(found, k) END AS resolved FROM h), rl AS (SELECT l_orderkey AS c, 'c' || o_custkey AS a, 'new:' || l_suppkey AS b, CASE WHEN l_tax = 0 THEN 'related_to' ELSE 'supplied_by' END AS t, l_discount * 11 AS conf FROM lineitem JOIN orders ON o_orderkey = l_orderkey) """


def captures(spark, sf):
    """Each order as a captured graph of its buyer and suppliers, resolved against the suppliers that are known."""
    o, li, s = (read(spark, sf, t) for t in ("orders", "lineitem", "supplier"))
    none, space = F.array().cast("array<string>"), F.lit("x").alias("space")
    buyers = o.select(F.col("o_orderkey").alias("capture_id"), space, F.concat(F.lit("c"), "o_custkey").alias("entity_key"), F.concat(F.lit("buyer "), "o_custkey").alias("canonical_name"), none.alias("aliases"))
    key = F.when(F.col("l_linenumber") == 7, F.concat(F.lit("s"), "l_suppkey")).otherwise(F.concat(F.lit("new:"), "l_suppkey"))
    sold = li.select(F.col("l_orderkey").alias("capture_id"), space, key.alias("entity_key"), F.concat(F.lit("Supplier  "), "l_suppkey").alias("canonical_name"), F.array(F.concat(F.lit(" supplier "), "l_suppkey")).alias("aliases"))
    edges = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("capture_id"), F.concat(F.lit("c"), "o_custkey").alias("subject"), F.concat(F.lit("new:"), "l_suppkey").alias("object"), F.when(F.col("l_tax") == 0, "related_to").otherwise("supplied_by").alias("rel_type"), (F.col("l_discount") * 11).alias("confidence"))
    surface = F.concat(F.lit("supplier "), "s_suppkey").alias("surface")
    known = s.select(space, F.concat(F.lit("s"), "s_suppkey").alias("entity_key"), surface).union(s.filter("s_suppkey % 40 = 0").select(space, F.concat(F.lit("twin"), "s_suppkey"), surface))
    return graph.capture(buyers.union(sold), edges, known)


@query("graph_capture_keys", CAPTURES + "SELECT c AS capture_id, k AS entity_key, resolved AS resolved_key FROM z")
def graph_capture_keys(spark, sf):
    return captures(spark, sf)[0]


@query("graph_capture_errors", CAPTURES + ", er AS (SELECT c, 'ambiguous' AS e FROM z WHERE NOT exact AND n > 1 UNION SELECT c, 'same_entity' FROM z GROUP BY c, resolved HAVING count(*) > 1 UNION SELECT c, 'repeated_key' FROM z WHERE times > 1 UNION SELECT c, 'untyped' FROM rl WHERE t = 'related_to' UNION SELECT c, 'undeclared' FROM rl WHERE (c, b) NOT IN (SELECT c, k FROM g) UNION SELECT c, 'confidence' FROM rl WHERE conf > 1 UNION SELECT c, 'repeated_edge' FROM rl GROUP BY c, a, t, b HAVING count(*) > 1) SELECT o.o_orderkey AS capture_id, string_agg(e, ',' ORDER BY e) AS errors FROM orders o LEFT JOIN er ON er.c = o.o_orderkey GROUP BY o.o_orderkey")
def graph_capture_errors(spark, sf):
    return captures(spark, sf)[1]


# --- duplicates ------------------------------------------------------------------
TERMSET = f"list_sort(list_filter(CASE WHEN len(list_filter(ts, lambda x: x NOT IN ({STOP}))) > 0 THEN list_filter(ts, lambda x: x NOT IN ({STOP})) ELSE ts END, lambda x: length(x) >= 3))"
#: The related texts of each text whose id is divisible by 20, from a table `base` (id, space, text).
RELATED = f"""t AS (SELECT id, space, w, {TERMSET} AS terms FROM (SELECT *, list_distinct(w) AS ts FROM (SELECT id, space, {TOK.format("coalesce(text, '')")} AS w FROM base))),
q AS (SELECT id AS query_id, space, terms, unnest(list_filter(terms, lambda x: length(x) >= 4)[1:12]) AS term FROM t WHERE asks(id) AND len(terms) >= 3), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
h AS (SELECT id, space, term, dl, count(*) AS tf FROM (SELECT id, space, len(w) AS dl, unnest(w) AS term FROM t) x WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM h GROUP BY term),
s AS (SELECT q.query_id, h.id, any_value(q.terms) AS terms, round(-sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS bm25 FROM h JOIN df USING (term) JOIN q ON q.term = h.term AND q.space = h.space, st GROUP BY q.query_id, h.id),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25, id) AS rank FROM s QUALIFY rank <= 51), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM p WHERE id <> query_id),
j AS (SELECT o.query_id AS id, o.id AS other, len(list_intersect(o.terms, t.terms)) AS i, len(o.terms) + len(t.terms) AS n FROM o JOIN t ON t.id = o.id WHERE k <= 50), related AS (SELECT id, other, round(i / (n - i), 6) AS similarity FROM j WHERE i / (n - i) >= 0.35)"""


@query("lexical_duplicates", "WITH base AS (SELECT doc_id AS id, lang AS space, text FROM documents), " + RELATED.replace("asks(id)", "id % 20 = 0") + " SELECT id, other, similarity FROM related")
def lexical_duplicates(spark, sf):
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("space"), "text")
    return duplicates.lexical_related(docs.filter("id % 20 = 0"), docs)


@query("duplicate_report", "WITH m AS (SELECT * FROM mem WHERE status = 'active'), base AS (SELECT memory_id AS id, space, content AS text FROM m), " + RELATED.replace("asks(id)", "CAST(substr(id, 5) AS BIGINT) % 20 = 0") + """,
g AS (SELECT memory_id AS id, 0 AS priority, 1.0 AS score, 'content' AS why, list(memory_id) OVER (PARTITION BY space, content_sha256 ORDER BY memory_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ids FROM m
 UNION ALL SELECT memory_id, 1, 0.95, 'claim', list(memory_id) OVER (PARTITION BY space, claim_key ORDER BY observed_at DESC, updated_at DESC, memory_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) FROM m
 UNION ALL SELECT memory_id, 1, 0.75, 'entity', list(memory_id) OVER (PARTITION BY space, entity_key, kind ORDER BY observed_at DESC, updated_at DESC, memory_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) FROM m WHERE entity_key IS NOT NULL),
c AS (SELECT id, priority, CAST(score AS DOUBLE) AS score, why, unnest(list_filter(ids[1:6], lambda x: x <> id)[1:5]) AS other FROM g UNION ALL SELECT id, 2, least(similarity, 0.94), 'lexical', other FROM related),
u AS (SELECT id, other, min(priority) AS priority, max(CASE WHEN priority = least_p THEN score END) AS score, string_agg(why, ',' ORDER BY why) AS matched_on FROM (SELECT *, min(priority) OVER (PARTITION BY id, other) AS least_p FROM c) GROUP BY id, other)
SELECT id, other, CAST(priority AS BIGINT) AS priority, score, matched_on, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority, score DESC, other) AS rank FROM u) WHERE rank <= 5""")
def duplicate_report(spark, sf):
    """All four arms; the lexical one for records whose number is divisible by 20."""
    m = view(spark, sf, "mem").filter("status = 'active'")
    return duplicates.candidates(m, m.filter("doc_id % 20 = 0"))


# --- scalar functions --------------------------------------------------------------
SLUGSTOP = ", ".join(f"'{w}'" for w in X.SLUG_STOPWORDS)


@query("entity_slugs", f"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(trim(text)), '^[a-z]+:', ''), '[^\\p{{L}}\\p{{N}}]+'), lambda x: strlen(x) >= 2 AND x NOT IN ({SLUGSTOP})) AS w FROM documents) SELECT doc_id, nullif(regexp_replace(list_max(list_filter(list_transform(range(0, 81), lambda n: substr(array_to_string(w[1:6], '-'), 1, CAST(n AS BIGINT))), lambda x: strlen(x) <= 80)), '-+$', ''), '') AS slug FROM w")
def entity_slugs(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.entity_slug(F.col("text")).alias("slug"))


@query("canonical_names", "SELECT DISTINCT p_brand AS key, trim(regexp_replace(translate(list_last(regexp_split_to_array(p_brand, '[:/#]')), '_-.', '   '), '\\s+', ' ', 'g')) AS name FROM part")
def canonical_names(spark, sf):
    return read(spark, sf, "part").select(F.col("p_brand").alias("key"), X.canonical_name(F.col("p_brand")).alias("name")).distinct()


@query("kind_inference", "WITH t AS (SELECT conv_id, turn, (['fact: ', '  remember:', 'decision:', 'revert: ', 'lesson:', 'action:', 'preference:', ''])[CAST((conv_id + turn) % 8 + 1 AS BIGINT)] AS p FROM conversations) SELECT conv_id, turn, CASE trim(p) WHEN 'fact:' THEN 'fact' WHEN 'remember:' THEN 'fact' WHEN 'decision:' THEN 'decision' WHEN 'revert:' THEN 'decision' WHEN 'lesson:' THEN 'lesson' WHEN 'action:' THEN 'action' WHEN 'preference:' THEN 'preference' END AS kind FROM t")
def kind_inference(spark, sf):
    p = F.array(*[F.lit(x) for x in ("fact: ", "  remember:", "decision:", "revert: ", "lesson:", "action:", "preference:", "")])
    c = read(spark, sf, "conversations").withColumn("p", F.element_at(p, ((F.col("conv_id") + F.col("turn")) % 8 + 1).cast("int")))
    return c.select("conv_id", "turn", X.kind_from_prefix(F.concat("p", F.lit("x"))).alias("kind"))


@query("folded_terms", "SELECT doc_id, strip_accents(text) AS folded FROM documents")
def folded_terms(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.fold(F.col("text")).alias("folded"))


@query("claim_fingerprints", "WITH x AS (SELECT doc_id, hex(encode(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')))) AS h FROM documents), b AS (SELECT doc_id, list_transform(regexp_extract_all(h, '..'), lambda y: CAST(('0x' || y) AS HUGEINT)) AS b FROM x) SELECT doc_id, lower(format('{:016x}', CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), b), lambda p, q: (xor(p, q) * 1099511628211) % 18446744073709551616) AS UBIGINT))) AS claim_key FROM b")
def claim_fingerprints(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.fingerprint(F.col("text")).alias("claim_key"))


@query("hex_round_trip", "SELECT doc_id, lower(hex(encode(text))) AS hex, true AS equal FROM documents")
def hex_round_trip(spark, sf):
    h = X.to_hex(F.encode("text", "UTF-8"))
    return read(spark, sf, "documents").select("doc_id", h.alias("hex"), (F.decode(X.from_hex(F.upper(h)), "UTF-8") == F.col("text")).alias("equal"))


# Fixed values, as in functions/text.py, for the SQL side.
ASKSTOP = ", ".join(f"'{w}'" for w in X.QUESTION_STOPWORDS)
KEYWORDS = f"""WITH k AS (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN 'temporal' WHEN 1 THEN 'adversarial' ELSE 'open' END AS category, array_to_string(list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: lower(trim(w, '.,?!:;()[]{{}}"''`\\/'))), lambda w: length(w) > 2 AND w NOT IN ({ASKSTOP}))[1:10], ' ') AS q FROM conversations) """


@query("keyword_queries", KEYWORDS + "SELECT conv_id, turn, q FROM k")
def keyword_queries(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", X.keyword_query(F.col("text")).alias("q"))


@query("query_bundles", KEYWORDS + ", b AS (SELECT conv_id, turn, trim(text) AS a, trim(q) AS b, CASE category WHEN 'temporal' THEN trim(q || ' date time when conversation') WHEN 'adversarial' THEN trim(q || ' no information available') ELSE '' END AS c FROM k) SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN a <> '' THEN a END, CASE WHEN b <> '' AND b <> a THEN b END, CASE WHEN c <> '' AND c <> b AND c <> a THEN c END], lambda x: x IS NOT NULL), ' | ') AS queries FROM b")
def query_bundles(spark, sf):
    category = F.when(F.col("turn") % 3 == 0, "temporal").when(F.col("turn") % 3 == 1, "adversarial").otherwise("open")
    return read(spark, sf, "conversations").select("conv_id", "turn", F.array_join(X.query_bundle(F.col("text"), category), " | ").alias("queries"))


@query("vector_blob_round_trip", "SELECT vec_id, true AS equal FROM embeddings")
def vector_blob_round_trip(spark, sf):
    v = read(spark, sf, "embeddings")
    return v.withColumn("b", vectors.to_bytes("embedding")).select("vec_id", (vectors.from_bytes("b") == F.col("embedding")).alias("equal"))


@query("verify_metadata", "SELECT memory_id, '{\"project\":\"p' || doc_id % 5 || '\",\"verified_at\":\"2024-02-01\",\"verified_against\":\"' || source || '\"}' AS metadata FROM mem")
def verify_metadata(spark, sf):
    m = view(spark, sf, "mem").withColumn("j", F.concat(F.lit('{"project":"p'), F.col("doc_id") % 5, F.lit('","verified_at":"old"}')))
    return m.select("memory_id", lifecycle.merge_map(F.col("j"), verified_at=F.lit("2024-02-01"), verified_against=F.col("source")).alias("metadata"))


# --- reranking, seeds, mentions, evidence contracts --------------------------------
@query("rerank_overlap", BM25 + ", c AS (SELECT r.query_id, r.id, r.rank, q.terms, list_distinct(" + TOK.format("substr(d.text, 1, 512)") + ") AS w FROM r JOIN q USING (query_id) JOIN documents d ON d.doc_id = r.id WHERE r.rank <= 16), z AS (SELECT query_id, id, rank, round(len(list_intersect(terms, w)) / len(terms), 6) AS score FROM c) SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM z")
def rerank_overlap(spark, sf):
    """The best 16 of each query, reordered by a scorer over the query and 512 characters."""
    from ..operators import rerank

    best = ranking.top_k(fulltext.bm25(corpus(spark, sf), items(spark, sf), 16), "query_id", [F.asc("bm25"), F.asc("id")], 16)
    pairs = best.join(corpus(spark, sf).withColumnRenamed("text", "document"), "id").join(items(spark, sf).withColumnRenamed("text", "query"), "query_id")
    rows = rerank.ordered(rerank.scored(pairs).withColumn("consensus", F.lit(False)).withColumn("activation", F.lit(None).cast("double")))
    return rows.select("query_id", "id", "score", "position")


@query("order_scores_without_reranker", BM25 + "SELECT query_id, id, CAST(count(*) OVER (PARTITION BY query_id) - rank + 1 AS DOUBLE) AS order_score FROM (SELECT * FROM r WHERE rank <= 16)")
def order_scores_without_reranker(spark, sf):
    from ..operators import rerank

    best = ranking.top_k(fulltext.bm25(corpus(spark, sf), items(spark, sf), 16), "query_id", [F.asc("bm25"), F.asc("id")], 16)
    rows = best.withColumn("score", F.lit(None).cast("double")).withColumn("consensus", F.lit(False)).withColumn("activation", F.lit(None).cast("double"))
    return rerank.ordered(rows).select("query_id", "id", "order_score")


@query("consensus_flags", ARMS + "SELECT l.query_id, l.id, a.id IS NOT NULL AS consensus FROM l LEFT JOIN a ON a.query_id = l.query_id AND a.id = l.id")
def consensus_flags(spark, sf):
    from ..operators import rerank

    lexical, semantic = arms(spark, sf)
    both = lexical.withColumnRenamed("rank", "lr").join(semantic.withColumnRenamed("rank", "sr"), ["query_id", "id"], "left")
    return both.select("query_id", "id", rerank.consensus(F.col("sr"), F.col("lr")).alias("consensus"))


@query("seed_allocation", "WITH m AS (SELECT o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ordinal, 'o' || o_orderkey AS id, 0 AS source FROM orders), e AS (SELECT o.o_custkey, row_number() OVER (PARTITION BY o.o_custkey ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey), 'p' || l.l_partkey, 1 FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey) SELECT query_id, id, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ordinal, source, id) AS position FROM (SELECT * FROM m UNION ALL SELECT * FROM e)) WHERE position <= 4")
def seed_allocation(spark, sf):
    from pyspark.sql import Window

    from ..operators import rerank

    o, li = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    by = lambda *c: F.row_number().over(Window.partitionBy("query_id").orderBy(*c))
    m = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("k")).select("query_id", by("k").alias("ordinal"), F.concat(F.lit("o"), "k").alias("id"))
    e = o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("query_id"), "l_orderkey", "l_linenumber", "l_partkey")
    e = e.select("query_id", by("l_orderkey", "l_linenumber", "l_partkey").alias("ordinal"), F.concat(F.lit("p"), "l_partkey").alias("id"))
    return rerank.seeds(m, e, 4).select("query_id", "id", "position")


@query("entity_mentions", "WITH t AS (SELECT p_partkey AS query_id, string_split(lower('the ' || p_name || ' of ' || p_type), ' ') AS w FROM part), n AS (SELECT name, min(id) AS entity_id FROM (SELECT DISTINCT lower(p_type) AS name, 't' AS id FROM part WHERE p_type = 'ECONOMY' UNION SELECT DISTINCT lower(string_split(p_name, ' ')[1]), 'a:' || lower(string_split(p_name, ' ')[1]) FROM part UNION SELECT 'of', 'x') GROUP BY name HAVING count(*) = 1) SELECT query_id, n.entity_id, i AS start, 1 AS length FROM (SELECT query_id, unnest(w) AS x, CAST(generate_subscripts(w, 1) AS BIGINT) AS i FROM t) s JOIN n ON n.name = s.x WHERE n.name <> 'of'")
def entity_mentions(spark, sf):
    p = read(spark, sf, "part")
    q = p.select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", F.lit("the"), "p_name", F.lit("of"), "p_type").alias("text"))
    first = F.lower(F.split("p_name", " ")[0])
    names = p.filter("p_type = 'ECONOMY'").select(F.lit("t").alias("entity_id"), F.col("p_type").alias("name")).unionByName(p.select(F.concat(F.lit("a:"), first).alias("entity_id"), first.alias("name"))).distinct()
    return graph.spans(q, names.unionByName(spark.createDataFrame([("x", "of")], "entity_id string, name string")))


@query("graph_context", NEAR.replace("b.depth < 3", "b.depth < 2") + ", x AS (SELECT a.seed, 'm' || e.edge_id AS memory_id, 0 AS arm, least(a.depth, c.depth) AS depth FROM e JOIN m a ON a.node = e.subject JOIN m c ON c.node = e.object AND c.seed = a.seed UNION ALL SELECT m.seed, 'c' || c.c_custkey, 1, m.depth FROM m JOIN customer c ON m.node = 'n' || c.c_nationkey), g AS (SELECT seed, memory_id, min(arm) AS arm, min(arm * 10 + depth) % 10 AS depth FROM x GROUP BY seed, memory_id), k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY arm, depth, memory_id) AS rank FROM g) SELECT seed, memory_id, CAST(arm AS BIGINT) AS arm, CAST(depth AS BIGINT) AS depth, rank FROM k WHERE rank <= 20")
def graph_context(spark, sf):
    edges, nodes = small_graph(spark, sf)
    about = read(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("memory_id"), F.concat(F.lit("n"), "c_nationkey").alias("node"))
    return graph.context(edges.withColumn("memory_id", F.concat(F.lit("m"), "edge_id")), nodes, about, 2, 20)


@query("evidence_edges", "SELECT l_orderkey * 100 + l_linenumber AS edge_id FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def evidence_edges(spark, sf):
    from ..operators import filters

    meta = F.to_json(F.struct((F.col("l_returnflag") == "R").cast("string").alias("routing"), F.lit("evidence").alias("contract"), F.lit("1").alias("version")))
    e = read(spark, sf, "lineitem").filter("l_linestatus = 'F'").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("edge_id"), F.lit("supplied_by").alias("rel_type"), meta.alias("metadata_json"))
    return filters.evidence_edges(e, "evidence", "1").select("edge_id")


@query("adjudication_guard", "SELECT event_id, CASE WHEN event_type <> 'signup' OR value > 20 THEN 'ok' ELSE 'refused' END AS verdict FROM events")
def adjudication_guard(spark, sf):
    from ..operators import filters

    source = F.to_json(F.struct(F.when(F.col("event_type") == "signup", "capture").otherwise("manual").alias("type"), F.when(F.col("value") > 20, "yes").alias("adjudication")))
    return read(spark, sf, "events").select("event_id", filters.adjudicated(source, False).alias("verdict"))


@query("request_filters", "SELECT memory_id FROM mem WHERE space IN ('en', 'fr') AND status = 'active' AND kind IN ('fact', 'decision')")
def request_filters(spark, sf):
    from ..operators import filters

    return view(spark, sf, "mem").filter(filters.spaces([" en", "fr"]) & filters.statuses(None) & filters.within(kind=["fact", "decision"], silo=[])).select("memory_id")
