"""Shared storage and small helpers of the llm operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What separates words: space and the ASCII controls 9 to 13, as bytes.split() does.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none and all runs in one process (tests in local mode)
    a temporary folder is set as checkpoint folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared storage, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = _fs(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df written to the shared storage and read back: a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_fs(uri: str):
    """pyarrow's filesystem and path for a URI of the shared storage."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def text_or_empty(c: str = "text"):
    return F.coalesce(quoted(c).cast("string"), F.lit(""))


def quoted(name: str):
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(names: list[str], *wanted: str) -> list[str]:
    """The wanted column names, changed so that none is among names."""
    have, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in have:
            w = f"_{w}"
        have.add(w.lower())
        out.append(w)
    return out


def trim(tokenizer: str | None = None) -> None:
    """Give the memory that earlier tasks of this Python worker have freed back to the system, with
    the word caches of tokenizers other than the one that the task is about to use."""
    import ctypes

    import pyarrow as pa

    from . import wordcache

    wordcache.forget(tokenizer)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mapped(df: DataFrame, function, *more: T.StructField) -> DataFrame:
    """df.mapInArrow(function) for a function that keeps df's columns, whatever their names, and adds `more`."""
    names = [f"c{k}" for k in range(len(df.columns) + len(more))]
    fields = [T.StructField(n, f.dataType) for n, f in zip(names, [*df.schema.fields, *more])]
    plain = df.toDF(*names[: len(df.columns)]).mapInArrow(lambda batches: (b.rename_columns(names) for b in function(batches)), T.StructType(fields))
    return plain.toDF(*df.columns, *(f.name for f in more))


def partitions(df: DataFrame) -> int:
    """A number of partitions by df's size in its files: about the session's advisory size each, from
    20,000 partitions on up to half a gigabyte each.  Where the size is unknown, Spark's default."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    target = int(spark._jsparkSession.sessionState().conf().getConf(spark._jvm.org.apache.spark.sql.internal.SQLConf.ADVISORY_PARTITION_SIZE_IN_BYTES()))
    return max(1, min(-(-size // target), max(20_000, -(-size // (512 << 20)))))


def lookup(rows: DataFrame, keyed: DataFrame, key: str, n_rows: int, many: str = "n", listed: bool = False) -> DataFrame:
    """rows joined with the one row of `keyed` for their key (inner), safe from hot keys.

    `keyed` holds in `many` how many of `rows` have its key.  Keys of more than
    n_rows / HOT rows (at least 100) are fewer than HOT, so their rows of `keyed`
    are broadcast and their rows stay where they are; the others meet in a shuffle.
    Both inputs should be stored: each is read twice.  With `listed` the keys of many rows come
    to the driver (fewer than HOT), and a filter, no join, tells the other rows from theirs.
    """
    at = max(100, n_rows // HOT)
    hot = F.broadcast(keyed.filter(F.col(many) > at).drop(many))
    cold = keyed.filter(F.col(many) <= at).drop(many)
    columns = [quoted(c) for c in [*rows.columns, *(c for c in cold.columns if c != key)]]
    if listed:
        keys = [r[0] for r in keyed.filter(F.col(many) > at).select(quoted(key)).collect()]
        warm = (rows.filter(~quoted(key).isin(keys)) if keys else rows).join(cold, key).select(columns)
        return rows.join(hot, key).select(columns).unionByName(warm) if keys else warm
    warm = rows.join(hot.select(key), key, "left_anti").join(cold, key)
    return rows.join(hot, key).select(columns).unionByName(warm.select(columns))


#: Most keys whose rows lookup() broadcasts.
HOT = 10_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node reachable over the undirected edges, for each node of an edge.

    Alternating large-star and small-star steps; each writes its edges to the shared
    storage, so no lineage builds up.  Hubs go through lookup().
    """
    spark = edges.sparkSession
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    n, before = now.count(), None
    while n:
        folder = scratch(spark, "components")
        written = lambda df, name: stored(df, name, f"{folder}/{name}")  # noqa: B023, E731
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
        large = lookup(both, least, "u", 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "large")
        # Every u has smaller neighbours only; all are linked to the least of them.
        small = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "small")
        linked = lookup(large, small, "u", n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(linked.unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        total = after.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        drop(spark, folder)
        now, n = after, total["n"]
        if before == (total["n"], total["h"]):
            break
        before = (total["n"], total["h"])
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
