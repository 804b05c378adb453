"""Reranking with a pluggable scorer, and the order of what it returns."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PREFIX = 512


def overlap(query: Column, document: Column) -> Column:
    """Default scorer: the share of the query's terms that the document has."""
    q = T.query_terms(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, T.tokens(document))) / F.size(q)).otherwise(0.0)


def scored(pairs: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series] | None = None, prefix: int = PREFIX) -> DataFrame:
    """pairs (query, document, ...) with score, by the document's first `prefix` characters (0: all).

    A scorer takes two series and returns one of as many scores; if it fails or returns
    another number, the batch keeps its plain order (null scores).
    """
    document = F.substring("document", 1, prefix) if prefix else F.col("document")
    if scorer is None:
        return pairs.withColumn("score", F.round(overlap(F.col("query"), document), 6))

    def run(query: pd.Series, doc: pd.Series) -> pd.Series:
        try:
            out = pd.Series(scorer(query, doc), dtype="float64")
        except Exception:  # noqa: BLE001  the contract: any failure keeps the plain order
            out = pd.Series([], dtype="float64")
        return out.reset_index(drop=True) if len(out) == len(query) else pd.Series([None] * len(query), dtype="float64")

    from pyspark.sql.types import DoubleType

    return pairs.withColumn("score", F.pandas_udf(run, DoubleType())("query", document))


def ordered(rows: DataFrame, key: str = "query_id") -> DataFrame:
    """Rank by score, consensus, activation (null last), then id.  Without any score in a query, the
    given `rank` stands and order scores n..1 take the place of scores."""
    w = Window.partitionBy(key)
    none = F.max("score").over(w).isNull()
    n = F.count("*").over(w)
    plain = n - F.row_number().over(w.orderBy("rank")) + 1
    rows = rows.withColumn("order_score", F.when(none, plain.cast("double")).otherwise(F.col("score")))
    order = [F.desc_nulls_last("order_score"), F.desc("consensus"), F.desc_nulls_last("activation"), F.asc("id")]
    return rows.withColumn("position", F.row_number().over(w.orderBy(*order)).cast("long"))


def consensus(graph_rank: Column, other_rank: Column) -> Column:
    """Reached over the graph and also by another arm."""
    return graph_rank.isNotNull() & other_rank.isNotNull()


def seeds(memories: DataFrame, entities: DataFrame, limit: int, key: str = "query_id") -> DataFrame:
    """Seeds of both sources, alternating, memories first (key, ordinal from 1, id)."""
    both = memories.select(key, "ordinal", "id", F.lit(0).alias("source")).unionByName(entities.select(key, "ordinal", "id", F.lit(1).alias("source")))
    w = Window.partitionBy(key).orderBy("ordinal", "source", "id")
    return both.withColumn("position", F.row_number().over(w).cast("long")).filter(F.col("position") <= limit)
