"""Record lifecycle as transformations: supersession, conflicts, ingest identity, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds whose arrival can retire an older claim.
RETIRING = ["fact", "preference", "decision", "lesson"]


def auto_supersede(rows: DataFrame, keys: list[str], arrival: str, observed: str, id_col: str) -> DataFrame:
    """A record is retired by the first later arrival of its key that is strictly newer.

    rows also has kind and pinned.  A late, older arrival leaves the newer one alone and
    stays active beside it; pinned records are never retired; arrivals of other kinds
    retire nothing.  Adds status and superseded_by.
    """
    later = Window.partitionBy(*keys).orderBy(arrival).rowsBetween(1, Window.unboundedFollowing)
    retiring = F.col("kind").isin(RETIRING)
    newest = F.max(F.when(retiring, F.col(observed))).over(later)
    out = rows.withColumn("_hit", ~F.col("pinned") & F.coalesce(newest > F.col(observed), F.lit(False)))
    followers = F.collect_list(F.when(retiring, F.struct(F.col(observed).alias("o"), F.col(id_col).alias("i")))).over(later)
    first = F.filter(followers, lambda x: x["o"] > F.col(observed))[0]["i"]
    out = out.withColumn("superseded_by", F.when(F.col("_hit"), first))
    return out.withColumn("status", F.when(F.col("_hit"), "superseded").otherwise("active")).drop("_hit")


def resolve(rows: DataFrame, mode: str) -> DataFrame:
    """What a write mode makes of found supersessions: append, suggest, conflict or supersede."""
    if mode not in ("append", "suggest", "conflict", "supersede"):
        raise ValueError(f"no write mode {mode}")
    link = {"append": None, "suggest": "suggests", "conflict": "contradicts", "supersede": "supersedes"}[mode]
    out = rows.withColumn("link_type", F.when(F.col("superseded_by").isNotNull(), F.lit(link)))
    return out if mode == "supersede" else out.withColumn("status", F.lit("active"))


def decided(submitted: DataFrame, decisions: DataFrame) -> DataFrame:
    """candidate_id, status, decided_at of each submission: only a pending one may be decided, so its
    first decision (by at, then seq) after submission counts and later ones change nothing.

    submitted: candidate_id, submitted_at; decisions: candidate_id, at, seq, decision (null: none).
    """
    later = submitted.join(decisions.filter("decision is not null"), "candidate_id").filter("at >= submitted_at")
    first = later.groupBy("candidate_id").agg(F.min(F.struct("at", "seq", "decision")).alias("f"))
    out = submitted.join(first, "candidate_id", "left")
    return out.select("candidate_id", F.coalesce("f.decision", F.lit("pending")).alias("status"), F.col("f.at").alias("decided_at"))


def visible(as_of: Column, valid_to: str = "valid_to", expires_at: str = "expires_at") -> Column:
    """valid_to itself is still valid, expires_at itself is not."""
    return (F.col(valid_to).isNull() | (F.col(valid_to) >= as_of)) & (F.col(expires_at).isNull() | (F.col(expires_at) > as_of))


def merge_map(json_col: Column, **entries: Column) -> Column:
    """A JSON object with entries set; null where the text is no object."""
    parsed = F.from_json(F.coalesce(json_col, F.lit("{}")), "map<string,string>")
    keys = list(entries)
    kept = F.map_filter(parsed, lambda k, v: ~k.isin(keys))
    new = F.create_map(*[x for k in keys for x in (F.lit(k), entries[k].cast("string"))])
    return F.when(parsed.isNotNull(), F.to_json(F.map_concat(kept, new)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of both by null-safe keys; a value of `new` wins unless it is null.  New rows of one key: the last by `seq`."""
    w = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    last = new.withColumn("_k", F.row_number().over(w)).filter("_k = 1").select(*[F.col(c).alias(f"n_{c}") for c in keys + values])
    on = None
    for k in keys:
        on = F.col(k).eqNullSafe(F.col(f"n_{k}")) if on is None else on & F.col(k).eqNullSafe(F.col(f"n_{k}"))
    both = old.withColumn("_o", F.lit(1)).join(last.withColumn("_n", F.lit(1)), on, "full_outer")
    return both.select(*[F.when(F.col("_o").isNull(), F.col(f"n_{k}")).otherwise(F.col(k)).alias(k) for k in keys], *[F.coalesce(f"n_{v}", v).alias(v) for v in values])
