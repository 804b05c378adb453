"""Integrity checks: each returns the rows that break a rule, with what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import STATUSES

# Bounds of what a store accepts.
MOST_CONTENT, MOST_SUMMARY, MOST_SOURCE, MOST_TAGS, MOST_TAG = 131_072, 8_192, 32_768, 64, 256


def valid_timestamp(c: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS, a fraction of any length or none, and Z; the day must exist."""
    part = lambda a, n: F.substring(c, a, n).try_cast("int")
    year, month, day = part(1, 4), part(6, 2), part(9, 2)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    grammar = c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?Z$") & ~c.contains("\n")
    good = grammar & month.between(1, 12) & day.between(1, last) & (part(12, 2) <= 23) & (part(15, 2) <= 59) & (part(18, 2) <= 59)
    return F.coalesce(good, F.lit(False))


def normal_timestamp(c: Column) -> Column:
    """A valid timestamp with just three digits of fraction, cut and not rounded; null otherwise."""
    digits = F.regexp_extract(c, r"\.([0-9]+)Z$", 1)
    return F.when(valid_timestamp(c), F.concat(F.substring(c, 1, 19), F.lit("."), F.rpad(F.substring(digits, 1, 3), 3, "0"), F.lit("Z")))


def is_object(c: Column) -> Column:
    """Whether a text is a JSON object."""
    return F.try_parse_json(c).isNotNull() & F.ltrim(c).startswith("{")


def broken(rows: DataFrame, keep: list[str], **rules: Column) -> DataFrame:
    """Rows that break any rule (true means broken), with the names of the rules they break."""
    wrong = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in sorted(rules.items())]))
    return rows.select(*keep, F.array_join(wrong, ",").alias("broken")).filter("broken <> ''")


def active_versions(memories: DataFrame, versions: DataFrame) -> DataFrame:
    """Records whose active version is missing or belongs to another record."""
    own = versions.select(F.col("version_id").alias("active_version_id"), "memory_id")
    return memories.join(own, ["active_version_id", "memory_id"], "left_anti").select("memory_id", "active_version_id")


def representations(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """Companion texts without a version, or with another hash than their own."""
    known = versions.select("version_id", F.lit(True).alias("there"))
    return broken(rows.join(known, "version_id", "left"), ["version_id"], no_version=F.col("there").isNull(), hash=F.sha2("text", 256) != F.col("text_sha256"))


def versions(rows: DataFrame) -> DataFrame:
    return broken(
        rows, ["version_id"], hash=F.sha2("content", 256) != F.col("content_sha256"), blank=F.trim("content") == "", content=F.length("content") > MOST_CONTENT,
        summary=F.length("summary") > MOST_SUMMARY, source=F.col("source_ref_json").isNotNull() & (~is_object(F.col("source_ref_json")) | (F.length("source_ref_json") > MOST_SOURCE)),
    )


def episodes(rows: DataFrame) -> DataFrame:
    return broken(
        rows, ["id"], chunk=~F.col("chunk_index").between(0, F.col("chunk_count") - 1), content=F.length("content") > MOST_CONTENT, hash=F.sha2("content", 256) != F.col("content_sha256"),
        metadata=F.col("metadata_json").isNotNull() & ~is_object(F.col("metadata_json")),
    )


def memories(rows: DataFrame) -> DataFrame:
    return broken(
        rows, ["memory_id"], status=~F.col("status").isin(STATUSES), confidence=~F.col("confidence").between(0, 1), expiry=F.col("expires_at") <= F.col("observed_at"),
        metadata=F.col("metadata_json").isNotNull() & ~is_object(F.col("metadata_json")), observed=~valid_timestamp(F.col("observed_text")),
    )


def tags(rows: DataFrame) -> DataFrame:
    """Records with too many, repeated, untrimmed, empty or too long tags."""
    t = F.col("tag")
    per = rows.groupBy("memory_id").agg(F.count("*").alias("n"), F.count_distinct("tag").alias("d"), F.max((F.trim(t) != t) | (t == "") | (F.length(t) > MOST_TAG)).alias("bad"))
    return broken(per, ["memory_id", "n"], many=F.col("n") > MOST_TAGS, repeated=F.col("d") < F.col("n"), form=F.col("bad"))


def across_spaces(edges: DataFrame, ends: DataFrame, key: str, column: str) -> DataFrame:
    """Edges whose own space is not that of what their `column` names (ends: key, space)."""
    there = ends.select(F.col(key).alias(column), F.col("space").alias("other_space"))
    return edges.join(there, column).filter(~F.col("space").eqNullSafe(F.col("other_space")))
