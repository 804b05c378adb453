"""Top-k per query, rank fusion, interleaving, scoring, budget packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Half-life decay: highest boost and half-life in days, by silo; and the fusion constant.
DURABLE, VOLATILE, RRF_K = (0.05, 180.0), (0.20, 30.0), 60


def top_k(df: DataFrame, key: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of each key, with their rank from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).filter(F.col(rank) <= k)


def pool_size(limit: int) -> int:
    """Candidates fetched before re-scoring."""
    return min(max(4 * limit, limit + 32), 200)


def page(df: DataFrame, key: str, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """limit rows behind offset; truncated and total_estimate come from one row more."""
    rows = top_k(df, key, order, offset + limit + 1).filter(F.col("rank") > offset)
    w = Window.partitionBy(key)
    more = F.max("rank").over(w) > offset + limit
    seen = F.least(F.count("*").over(w), F.lit(limit))
    return rows.withColumn("truncated", more).withColumn("total_estimate", offset + seen + more.cast("long")).filter(F.col("rank") <= offset + limit)


def recency(anchor: Column, silo: Column, as_of: Column) -> Column:
    """max * 0.5 ** (age / half-life); the future has age 0, null counts nothing."""
    age = F.greatest((F.unix_micros(as_of) - F.unix_micros(anchor)) / F.lit(86_400_000_000.0), F.lit(0.0))
    decay = lambda m, h: m * F.pow(F.lit(0.5), age / h)
    return F.when(anchor.isNull(), 0.0).when(silo == "durable", decay(*DURABLE)).otherwise(decay(*VOLATILE))


def relative(bm25: Column, best: Column) -> Column:
    """bm25 / best clamped to 0..1 (both negative, lower is better), else 0."""
    return F.when((best < 0) & (bm25 < 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), bm25 / best))).otherwise(0.0)


def metadata(confidence: Column, kind_hit: Column, entity_hit: Column, claim_hit: Column, tag_hit: Column, alias_hit: Column) -> Column:
    part = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)) * 0.05 + part(kind_hit, 0.05) + part(entity_hit, 0.10) + part(claim_hit, 0.10) + part(tag_hit, 0.05) + part(alias_hit, 0.5)


def source_tier(source_type: Column, tags: Column) -> Column:
    return F.when(F.array_contains(tags, "synthesis-derived"), 0.0).when(source_type == "synthesis", 0.0).when(source_type.isin("manual", "mcp"), 0.04).otherwise(0.02)


def linear_recency(anchor: Column, silo: Column, as_of: Column) -> Column:
    """max * (1 - age / (2 * half-life)), 0 from there on; null counts nothing."""
    age = F.greatest((F.unix_micros(as_of) - F.unix_micros(anchor)) / F.lit(86_400_000_000.0), F.lit(0.0))
    fall = lambda m, h: m * F.greatest(F.lit(0.0), 1 - age / (2 * h))
    return F.coalesce(F.when(silo == "durable", fall(*DURABLE)).otherwise(fall(*VOLATILE)), F.lit(0.0))


def hits(kinds=(), entity_keys=(), claim_keys=(), tags=()) -> list[Column]:
    """Whether a record has what a request filters by: kind, entity, claim, tag; for metadata()."""
    among = lambda c, given: F.col(c).isin(list(given)) if given else F.lit(False)
    return [among("kind", kinds), among("entity_key", entity_keys), among("claim_key", claim_keys), F.arrays_overlap("tags", F.array(*map(F.lit, tags))) if tags else F.lit(False)]


def standing(scopes=()) -> Column:
    """Scope asked for .03, active .02, pinned .05."""
    scope = F.when(F.col("scope").isin(list(scopes)), 0.03).otherwise(0.0) if scopes else F.lit(0.0)
    return scope + F.when(F.col("status") == "active", 0.02).otherwise(0.0) + F.when(F.col("pinned"), 0.05).otherwise(0.0)


def tiebreak(confidence: Column, found: list[Column], anchor: Column, silo: Column, as_of: Column, scopes=()) -> Column:
    """What orders rows of equal relevance into a pool: metadata without aliases, linear recency, standing."""
    return metadata(confidence, *found, F.lit(False)) + linear_recency(anchor, silo, as_of) + standing(scopes)


def rrf(arms: dict[str, DataFrame], limit: int) -> DataFrame:
    """Reciprocal rank fusion of ranked arms (query_id, id, rank): score, match_type, rank."""
    rows = None
    for name, df in arms.items():
        part = df.select("query_id", "id", F.col("rank").cast("double").alias("r"), F.lit(name).alias("arm"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "id").agg(F.round(F.sum(1 / (RRF_K + F.col("r"))), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("arm")), "+").alias("arms"))
    fused = fused.withColumn("match_type", F.when(F.col("arms").contains("+"), "hybrid").otherwise(F.col("arms"))).drop("arms")
    return top_k(fused, "query_id", [F.desc("score"), F.asc("id")], limit)


def interleave(lists: DataFrame, group: str, order: str, cap: int) -> DataFrame:
    """Round robin over ranked lists (group, `order` of the list, rank, id): each id once, where it comes first."""
    first = lists.groupBy(group, "id").agg(F.min(F.struct("rank", order)).alias("at"))
    rows = top_k(first, group, [F.col("at.rank"), F.col(f"at.{order}"), F.col("id")], cap, "position")
    return rows.select(group, "id", F.col("at.rank").alias("rank"), F.col(f"at.{order}").alias(order), "position")


def pack(df: DataFrame, key: str, order: list[Column], line: Column, budget: int, unit: str = "chars") -> DataFrame:
    """Lines in order while all so far (with their newlines) fit the budget; if not even the first
    fits, the first cut to the budget with an ellipsis."""
    length = F.length if unit == "chars" else F.octet_length
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("line", line).withColumn("position", F.row_number().over(w).cast("long"))
    rows = rows.withColumn("used", F.sum(length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.col("used") <= budget
    cut = F.concat(F.substring("line", 1, budget - 1), F.lit("…"))
    rows = rows.filter(fits | (F.col("position") == 1))
    return rows.withColumn("line", F.when(fits, F.col("line")).otherwise(cut)).withColumn("truncated", ~fits)
