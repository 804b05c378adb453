"""Interchange archive (JSON lines: header, rows by table, footer) and usage ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 1


def export(tables: dict[str, tuple[DataFrame, list[str]]], path: str) -> DataFrame:
    """Write the archive as text parts in order; returns table, n, sha256 of the row lines' digests.

    tables: name -> (rows, order).  Lines sort by (table, order), so equal content gives
    equal text.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    lines = None
    for k, (name, (df, order)) in enumerate(sorted(tables.items()), 1):
        body = F.to_json(F.struct(F.lit("row").alias("kind"), F.lit(name).alias("table"), F.struct(*df.columns).alias("values")), {"ignoreNullFields": "false"})
        part = df.select(F.lit(k).alias("part"), F.concat_ws("\x1f", *[F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("")), 24, " ") for c in order]).alias("at"), F.lit(name).alias("table"), body.alias("line"))
        lines = part if lines is None else lines.unionByName(part)
    counts = lines.groupBy("table").agg(F.count("*").alias("n"), F.sha2(F.bit_xor(F.xxhash64("line")).cast("string"), 256).alias("sha256"))
    head = spark.createDataFrame([(0, "", "", '{"kind":"header","version":%d}' % VERSION)], "part int, at string, table string, line string")
    foot = counts.agg(F.to_json(F.struct(F.lit("footer").alias("kind"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("table", "n")))).alias("counts"))).alias("line"))
    foot = foot.select(F.lit(len(tables) + 1).alias("part"), F.lit("").alias("at"), F.lit("").alias("table"), "line")
    head.unionByName(lines).unionByName(foot).repartitionByRange("part", "at").sortWithinPartitions("part", "at").select("line").write.mode("errorifexists").text(path)
    return counts


def load(spark: SparkSession, path: str, schemas: dict[str, T.StructType]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of an archive, and its bad lines (line, reason).

    Raises if the archive has no header of this version, no footer, or other counts than
    its footer says.
    """
    raw = spark.read.text(path).withColumnRenamed("value", "line")
    kind = F.get_json_object("line", "$.kind")
    marks = {r[0]: r for r in raw.select(kind, "line").filter(kind.isin("header", "footer")).collect()}
    if "header" not in marks or f'"version":{VERSION}' not in marks["header"][1]:
        raise ValueError("no archive of this version")
    if "footer" not in marks:
        raise ValueError("the archive is cut off")
    rows = raw.filter(kind.eqNullSafe("row") | kind.isNull() | ~kind.isin("header", "footer"))
    table = F.get_json_object("line", "$.table")
    out = {}
    for name, schema in schemas.items():
        full = T.StructType([T.StructField("values", schema)])
        out[name] = rows.filter(kind.eqNullSafe("row") & table.eqNullSafe(name)).select(F.from_json("line", full).alias("r")).select("r.values.*")
    bad = rows.filter(~kind.eqNullSafe("row") | ~F.coalesce(table.isin(list(schemas)), F.lit(False))).select("line", F.when(kind.isNull(), "malformed").when(kind != "row", "unknown kind").otherwise("unknown table").alias("reason"))
    import json

    said = json.loads(marks["footer"][1])["counts"]
    got = {r[0]: r[1] for r in rows.filter(kind.eqNullSafe("row")).groupBy(table).count().collect()}
    if {k: v for k, v in said.items() if v} != got:
        raise ValueError(f"the footer says {said}, the archive has {got}")
    return out, bad


def usage_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Events of every *.jsonl in a folder; malformed lines are dropped."""
    schema = "ts long, model string, operation string, items long, tokens long, latency_ms long, ok boolean"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{folder.rstrip('/')}/*.jsonl")


def backup(spark: SparkSession, tables: dict[str, str], to: str) -> None:
    """Copy table folders; a target that exists is an error."""
    for name, path in tables.items():
        spark.read.parquet(path).write.mode("errorifexists").parquet(f"{to.rstrip('/')}/{name}.parquet")
