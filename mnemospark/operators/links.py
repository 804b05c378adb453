"""Links proposed by shared tags, and the entity edges they amount to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags that say nothing of a topic, and beginnings of such tags.
NOISE = (
    "action decision summary reference fact lesson continuity preference task status done resolved review commit synthesis "
    "synthesis-derived built implemented"
).split()
NOISE_STARTS = ["session:", "proposal-kind-"]
#: A tag on more records than this of its space tells nothing; links need so many tags in common.
MOST, LEAST = 25, 2


def telling(tag: Column) -> Column:
    low = F.lower(tag)
    out = ~low.isin(NOISE)
    for start in NOISE_STARTS:
        out = out & ~low.startswith(start)
    return out


def tag_links(tags: DataFrame, most: int = MOST, least: int = LEAST) -> DataFrame:
    """src, dst, shared, tags, confidence of active records of different entities that share telling tags.

    tags: memory_id, space, entity_key, status, tag.  Only tags of at most `most` records make
    pairs: each becomes one short array, whose pairs are unfolded in place without a join.
    """
    rows = tags.filter((F.col("status") == "active") & (F.trim("entity_key") != "") & telling(F.col("tag"))).select("space", "tag", "memory_id", "entity_key").distinct()
    common = rows.groupBy("space", "tag").agg(F.count_distinct("memory_id").alias("df")).filter(~F.col("df").between(2, most)).select("space", "tag")
    rare = rows.join(common, ["space", "tag"], "left_anti")
    groups = rare.groupBy("space", "tag").agg(F.array_sort(F.collect_list(F.struct(F.col("memory_id").alias("id"), F.col("entity_key").alias("e")))).alias("g"))
    pairs = F.flatten(F.transform("g", lambda x, i: F.transform(F.slice("g", i + 2, most), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    one = groups.select("tag", F.explode(pairs).alias("p")).filter("p.x.id < p.y.id and p.x.e <> p.y.e")
    found = one.groupBy(F.col("p.x.id").alias("src"), F.col("p.y.id").alias("dst")).agg(F.count("*").alias("shared"), F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))
    return found.filter(F.col("shared") >= least).withColumn("confidence", F.col("shared") / (F.col("shared") + 1.0))


def new_links(found: DataFrame, have: DataFrame) -> DataFrame:
    """Links whose two ends, either way round, are not linked yet (have: src, dst)."""
    known = have.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return found.join(known, ["src", "dst"], "left_anti")


def entity_links(found: DataFrame, memories: DataFrame) -> DataFrame:
    """subject, object (the lesser key first), src, dst, evidence, confidence: links summed by the entities of their ends."""
    ends = memories.select("memory_id", "entity_key")
    rows = found.join(ends.toDF("src", "a"), "src").join(ends.toDF("dst", "b"), "dst")
    out = rows.groupBy(F.least("a", "b").alias("subject"), F.greatest("a", "b").alias("object")).agg(F.min("src").alias("src"), F.min("dst").alias("dst"), F.count("*").alias("evidence"))
    return out.withColumn("confidence", F.col("evidence") / (F.col("evidence") + 1.0))
