"""Write-time duplicate report: exact text, claim, entity and lexical candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import fulltext
from .ranking import top_k

# Least similarity, rows reported, terms asked for, their length, rows looked at.
LEXICAL, MOST, FIRST, LONG, SCAN = 0.35, 5, 12, 4, 50


def jaccard(a, b):
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def term_set(text: Column) -> Column:
    return F.filter(T.query_terms(text), lambda t: F.length(t) >= 3)


def lexical_related(asking: DataFrame, docs: DataFrame) -> DataFrame:
    """id, other, similarity of the documents (id, space, text) related to each of `asking` (the same columns).

    The FIRST terms of LONG characters of a text ask by BM25 for the SCAN best documents of its
    space; those whose term sets are similar enough remain.  A text of under three terms asks nothing.
    """
    long = F.filter("terms", lambda t: F.length(t) >= LONG)
    asked = asking.select(F.col("id").alias("query_id"), "space", term_set(F.col("text")).alias("terms")).filter(F.size("terms") >= 3)
    words = asked.select("query_id", "space", F.array_join(F.slice(long, 1, FIRST), " ").alias("text")).filter("text <> ''")
    found = top_k(fulltext.scored(docs.select("id", "text", "space"), words, SCAN + 1, group="space"), "query_id", [F.asc("bm25"), F.asc("id")], SCAN + 1)
    pairs = top_k(found.drop("rank").filter("id <> query_id"), "query_id", [F.asc("bm25"), F.asc("id")], SCAN)
    rows = pairs.join(docs.select("id", term_set(F.col("text")).alias("o")), "id").join(asked.select("query_id", "terms"), "query_id")
    rows = rows.withColumn("similarity", jaccard(F.col("terms"), F.col("o"))).filter(F.col("similarity") >= LEXICAL)
    return rows.select(F.col("query_id").alias("id"), F.col("id").alias("other"), F.round("similarity", 6).alias("similarity"))


def first_others(rows: DataFrame, keys: list[str], id_col: str, most: int, order: list[Column] | None = None) -> DataFrame:
    """rows with each of the first `most` other ids of their group (other, k): the group's first
    most + 1 ids are ranked once and joined to its rows, so a group makes no pairs beyond that."""
    w = Window.partitionBy(*keys).orderBy(*(order or []), id_col)
    head = rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most + 1)
    heads = head.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_k", F.col(id_col).alias("id")))).alias("_heads"))
    others = F.slice(F.filter(F.col("_heads.id"), lambda o: o != F.col(id_col)), 1, most)
    out = rows.join(heads, keys).select(*[rows[c] for c in rows.columns], others.alias("_others"))
    return out.select("*", F.posexplode("_others").alias("_k", "other")).withColumn("k", (F.col("_k") + 1).cast("long")).drop("_others", "_k")


def candidates(rows: DataFrame, asking: DataFrame) -> DataFrame:
    """Write-time report: equal content, claim, entity and kind of every row, and lexical relatives of `asking`.

    rows: memory_id, space, content, content_sha256, entity_key, claim_key, kind, observed_at,
    updated_at; asking: some of its rows.  Priorities: 0 duplicate, 1 update, 2 related.
    """
    latest = [F.desc("observed_at"), F.desc("updated_at")]

    def arm(keys, order, priority, score, why):
        keyed = rows.filter(" and ".join(f"{k} is not null" for k in keys))
        return first_others(keyed, keys, "memory_id", MOST, order).select(F.col("memory_id").alias("id"), "other", F.lit(priority).cast("long").alias("priority"), F.lit(score).alias("score"), F.lit(why).alias("matched_on"))

    text = lambda df: df.select(F.col("memory_id").alias("id"), "space", F.col("content").alias("text"))
    related = lexical_related(text(asking), text(rows)).select("id", "other", F.lit(2).cast("long").alias("priority"), F.least("similarity", F.lit(0.94)).alias("score"), F.lit("lexical").alias("matched_on"))
    return report([arm(["space", "content_sha256"], [], 0, 1.0, "content"), arm(["space", "claim_key"], latest, 1, 0.95, "claim"), arm(["space", "entity_key", "kind"], latest, 1, 0.75, "entity"), related])


def report(parts: list[DataFrame], most: int = MOST) -> DataFrame:
    """Of candidates (id, other, priority, score, matched_on) the best relationship of each pair
    (lower priority, then higher score), reasons united; the first `most` of each id."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    one = rows.groupBy("id", "other").agg(F.min(F.struct("priority", (-F.col("score")).alias("s"))).alias("b"), F.array_join(F.array_sort(F.collect_set("matched_on")), ",").alias("matched_on"))
    flat = one.select("id", "other", F.col("b.priority").alias("priority"), (-F.col("b.s")).alias("score"), "matched_on")
    return top_k(flat, "id", [F.asc("priority"), F.desc("score"), F.asc("other")], most)
