"""Filters: validation of requests, space resolution, evidence contracts, adjudication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a request may name.
KINDS = ["fact", "preference", "decision", "action", "lesson", "event", "summary", "reference", "task", "note"]
STATUSES = ["active", "superseded", "expired", "tombstoned", "quarantined"]
SCOPES = ["global", "user", "workspace", "project", "session"]
DEFAULT_SPACE, ALL_SPACES, MOST_VALUES, MOST_CHARS = "default", "*", 64, 256


def values(given: list[str] | None, allowed: list[str] | None = None) -> list[str]:
    """Trimmed values of a filter; raises on empty, too long, repeated, too many or unknown ones."""
    out = [v.strip() for v in given or []]
    if len(out) > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} values")
    if any(not v or len(v) > MOST_CHARS for v in out):
        raise ValueError("a value is empty or too long")
    if len(set(out)) < len(out):
        raise ValueError("a value is given twice")
    if allowed is not None and (bad := [v for v in out if v not in allowed]):
        raise ValueError(f"unknown: {', '.join(bad)}")
    return out


def within(**columns: list[str] | None) -> Column:
    """All columns among their values; a column without values is not asked."""
    out = F.lit(True)
    for name, given in columns.items():
        if given:
            out = out & F.col(name).isin(values(given))
    return out


def spaces(given: list[str] | None, column: str = "space") -> Column:
    """No space means the default one; * means all."""
    given = values(given)
    if ALL_SPACES in given:
        return F.lit(True)
    return F.col(column).isin(given or [DEFAULT_SPACE])


def statuses(given: list[str] | None, column: str = "status") -> Column:
    return F.col(column).isin(values(given, STATUSES) or ["active"])


def evidence_edges(edges: DataFrame, contract: str, version: str, metadata: str = "metadata_json") -> DataFrame:
    """Edges that may route: routing = true under the contract.  A routing edge under another contract
    is an error when the rows are read, not a dropped row."""
    field = lambda k: F.get_json_object(metadata, f"$.{k}")
    routing = field("routing").eqNullSafe("true")
    good = field("contract").eqNullSafe(contract) & field("version").eqNullSafe(version) & (F.col("rel_type") != "related_to")
    checked = F.when(~good, F.raise_error(F.concat(F.lit("malformed evidence contract on edge "), F.col("edge_id").cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return edges.filter(routing).withColumn("_ok", checked).filter("_ok").drop("_ok")


def adjudicated(source: Column, degrade: bool) -> Column:
    """ok with a verdict; without one refused, or degraded where that is allowed.  Others pass."""
    capture = F.get_json_object(source, "$.type").eqNullSafe("capture")
    verdict = F.get_json_object(source, "$.adjudication").isNotNull()
    return F.when(~capture | verdict, "ok").otherwise("degraded" if degrade else "refused")
