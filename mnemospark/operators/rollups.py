"""Counts and rankings over records, telemetry and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import top_k


def duplicate_groups(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """keys, n and the sorted ids of each group of more than one row."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(id_col)).alias("members")).filter("n > 1")


def dedupe_proposals(rows: DataFrame, keys: list[str], most: int = 20) -> DataFrame:
    """keys, canonical (pinned first, then the least id), the first `most` others by id, and n.

    Others are ranked before they are gathered, so a group of any size is gathered as `most` ids.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("pinned"), "memory_id")
    ranked = rows.withColumn("k", F.row_number().over(w))
    out = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.when(F.col("k") == 1, F.col("memory_id"))).alias("canonical"), F.array_sort(F.collect_list(F.when(F.col("k").between(2, most + 1), F.col("memory_id")))).alias("duplicates"))
    return out.filter("n > 1")


def promotable(recall: DataFrame, score: float = 0.5, rank: int = 3, sessions: int = 3) -> DataFrame:
    """memory_id, sessions: records recalled well in enough different sessions."""
    good = recall.filter(F.col("session_id").isNotNull() & (F.col("score") >= score) & (F.col("rank") <= rank))
    return good.groupBy("memory_id").agg(F.count_distinct("session_id").alias("sessions")).filter(F.col("sessions") >= sessions)


def nearest_rank(rows: DataFrame, key: str, value: str, tie: str, shares: dict[str, float]) -> DataFrame:
    """For each key the value at place round(share * (n - 1)), and n."""
    w = Window.partitionBy(key)
    at = rows.withColumn("i", F.row_number().over(w.orderBy(value, tie)) - 1).withColumn("n", F.count("*").over(w))
    place = lambda p: F.floor(F.lit(p) * (F.col("n") - 1) + 0.5)
    return at.groupBy(key).agg(*[F.max(F.when(F.col("i") == place(p), F.col(value))).alias(name) for name, p in shares.items()], F.max("n").alias("n"))


def retrieval_metrics(hits: DataFrame, k: int = 10) -> DataFrame:
    """By category and overall: hit@k, MRR and recall@k.  hits: category, first_hit, found, relevant."""
    each = hits.withColumn("hit", (F.col("first_hit") <= k).cast("double")).withColumn("rr", 1 / F.col("first_hit")).withColumn("recall", F.try_divide("found", "relevant"))
    mean = lambda c: F.round(F.avg(F.coalesce(F.col(c), F.lit(0.0))), 6)
    return each.cube("category").agg(F.count("*").alias("questions"), mean("hit").alias(f"hit_at_{k}"), mean("rr").alias("mrr"), mean("recall").alias(f"recall_at_{k}")).withColumn("category", F.coalesce("category", F.lit("overall")))


def degrees(edges: DataFrame, weight: Column | None = None) -> DataFrame:
    """id, degree: the sum of the weights (1 by default) of a node's edges, both ways."""
    w = F.lit(1).cast("long") if weight is None else weight
    return edges.select(F.explode(F.array("subject", "object")).alias("id"), w.alias("w")).groupBy("id").agg(F.sum("w").alias("degree"))


def top_degree(edges: DataFrame, most: int) -> DataFrame:
    """The edges between the `most` nodes of highest degree, counted by their ends."""
    top = degrees(edges).orderBy(F.desc("degree"), "id").limit(most).select("id")
    held = edges.join(top.select(F.col("id").alias("subject")), "subject", "left_semi").join(top.select(F.col("id").alias("object")), "object", "left_semi")
    return held.groupBy("subject", "object").agg(F.count("*").alias("n"))


def latest(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    return top_k(rows, key, order, most)


def running(rows: DataFrame, key: str, order: str, size: Column) -> DataFrame:
    """start and stop of each row when the rows of a key are laid end to end, one apart."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("stop", F.sum(size + 1).over(w) - 1).withColumn("start", F.col("stop") - size)
