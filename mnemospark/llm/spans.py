"""Places of regular-expression matches, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str, when: Column, group: int = 0) -> Column:
    """All matches, leftmost and non-overlapping; none where `when` is not true."""
    return F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))


def between(text: Column, pattern: str, found: Column) -> Column:
    """What stands before, between and after the matches; nothing if there are none."""
    return F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))


def located(found: str, pieces: str) -> Column:
    """structs (s, start): each match with its first code point, counted from 0; one fold over the pieces."""
    return F.expr(
        f"aggregate(zip_with(slice({pieces}, 1, size({found})), {found}, (p, s) -> named_struct('p', p, 's', s)), named_struct('at', 0, 'out', cast(array() as array<struct<s: string, start: int>>)),"
        f" (a, x) -> named_struct('at', a.at + length(x.p) + length(x.s), 'out', concat(a.out, array(named_struct('s', x.s, 'start', a.at + length(x.p))))), a -> a.out)"
    )
