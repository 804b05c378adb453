"""Quality rules as a short-circuit cascade.

Each rule rejects a text by one cheap measurement.  On a sample of about SAMPLE rows, of
at most FILES files where docs are files, every rule is timed and its rejections are
counted; the cascade then asks the rules in order of rejections per second, and the first
that rejects a text ends its turn.  The order changes the cost only: a text is kept if no
rule rejects it.  judge() reports all counts and so takes all measurements; the cascade
saves its work in filter_documents().

Measurements are shared within a text (a rule that needs the words finds them cut
already).  Whole texts are measured, never prefixes.

Defined cases: a null or empty text has no words and is rejected; a null doc_id is
kept as it is; repeated rows are each judged; texts of any length are measured whole (some
100 bytes of memory a word) and none is rejected for its length alone; rules of equal worth
are asked by cost, then name; an empty table gives an empty result; further columns pass
through filter_documents() untouched.
"""

from __future__ import annotations

import time
import urllib.parse
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SAMPLE, FILES = 2_000, 8
SYMBOLS = "#*$%&|<>"
COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


class Text:
    """Measurements of one text, each taken when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(self.text.count(c) for c in " \t\n\x0b\x0c\r")

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.text.count(c) for c in SYMBOLS)

    @cached_property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return [x for x in self.text.split("\n") if x.strip(" \t\x0b\x0c\r")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in 3-word windows that the text has twice or more."""
        n = self.n_words
        if n < 4:
            return 0
        names: dict[bytes, int] = {}
        ids = np.array([names.setdefault(w, len(names)) for w in self.words], dtype=np.int64)
        if len(names) < 1 << 21:
            windows = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
        else:
            pairs = np.unique(ids[:-2] * len(names) + ids[1:-1], return_inverse=True)[1]
            windows = pairs * len(names) + ids[2:]
        order = np.argsort(windows, kind="stable")
        equal = windows[order[1:]] == windows[order[:-1]]
        if not equal.any():
            return 0
        hit = np.zeros(n, dtype=bool)
        at = order[np.append(equal, False) | np.append(False, equal)]
        hit[at] = hit[at + 1] = hit[at + 2] = True
        return int(hit.sum())

    @cached_property
    def n_shouts(self) -> int:
        return self.text.count("!")

    @cached_property
    def n_bullets(self) -> int:
        return sum(x.lstrip()[:1] in ("-", "*", "•") for x in self.lines)

    @cached_property
    def n_cut_lines(self) -> int:
        return sum(x.rstrip().endswith(("...", "…")) for x in self.lines)

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


#: name: whether it rejects the text.
RULES = {
    "few_words": lambda t: t.n_words < 50,
    "repeated_windows": lambda t: 100 * t.n_repeat_words > 50 * t.n_words,
    "short_words": lambda t: t.word_chars < 3 * t.n_words,
    "long_words": lambda t: t.word_chars > 12 * t.n_words,
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "repeated_lines": lambda t: 10 * t.n_dup_lines > 6 * len(t.lines),
    "shouting": lambda t: 2 * t.n_shouts > t.n_words,
    "bullets": lambda t: 10 * t.n_bullets > 9 * len(t.lines),
    "cut_lines": lambda t: 10 * t.n_cut_lines > 3 * len(t.lines),
}


def _few_files(docs: DataFrame, text_col: str) -> DataFrame:
    """The texts of FILES of docs' Parquet files, by hash of their names; of docs if they are no such files."""
    from pyspark.errors import AnalysisException

    files = sorted(docs.inputFiles(), key=lambda f: zlib.crc32(f.encode()))
    if len(files) > FILES and all(f.endswith(".parquet") for f in files):
        try:
            return docs.sparkSession.read.parquet(*map(urllib.parse.unquote, files[:FILES])).select(shared.quoted(text_col).cast("string").alias("text"))
        except AnalysisException:  # the column is not one of the files
            pass
    return docs.select(shared.quoted(text_col).cast("string").alias("text"))


def plan(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) in the order of the cascade."""
    some = _few_files(docs, text_col)
    n = some.count()
    if n > sample:
        some = some.sample(sample / n, seed=7).limit(2 * sample)

    def measure(batches):
        cost, rejected, n = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                n += 1
                for name, rule in RULES.items():
                    t = Text(text)
                    began = time.perf_counter()
                    rejected[name] += rule(t)
                    cost[name] += time.perf_counter() - began
        if n:
            yield pa.RecordBatch.from_pydict({"rule": list(RULES), "s": list(cost.values()), "rejected": list(rejected.values()), "n": [n] * len(RULES)})

    found = some.mapInArrow(measure, "rule string, s double, rejected long, n long").groupBy("rule").agg(F.sum("s"), F.sum("rejected"), F.sum("n")).collect()
    rated = [(r[0], r[1] / r[3], r[2] / r[3]) for r in found] or [(name, 0.0, 0.0) for name in RULES]
    return sorted(rated, key=lambda r: (-(r[2] / max(r[1], 1e-9)), r[1], r[0]))


def verdict(text: Text, order: list[str]) -> str | None:
    """The rule that rejects the text, or None."""
    for name in order:
        if RULES[name](text):
            return name
    return None


def filter_documents(docs: DataFrame, text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns."""
    order = order or [name for name, _, _ in plan(docs, text_col)]
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            keep = [verdict(Text(t.as_py()), order) is None for t in b.column(at)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return shared.mapped(docs, run)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """Counts and verdict of each row, with the rejecting rule as `rule`."""
    order = order or [name for name, _, _ in plan(docs, text_col)]

    def run(batches):
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                t = Text(text.as_py())
                rule = verdict(t, order)
                rows.append((key, t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, t.base_failed, not t.base_failed and rule is None, rule))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [*[pa.int64()] * 6, pa.bool_(), pa.bool_(), pa.string()])], names=[x.split(" ")[0] for x in COUNTS.split(", ")] + ["rule"])

    return docs.select(shared.quoted(id_col).cast("long").alias("doc_id"), shared.quoted(text_col).cast("string").alias("text")).mapInArrow(run, COUNTS + ", rule string")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(shared.table(spark, sf_dir, "documents")).drop("rule")


#: Rows (doc_id, n_words, ..., base_failed, kept) of a table `documents`, in DuckDB.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT k, i, struct_pack(a := ws[i], b := ws[i + 1], c := ws[i + 2]) AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT k, i FROM g QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
n AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY k),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(t, '[^!]', '', 'g')) AS n_shouts,
  len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS n_bullets, len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_cut
  FROM w LEFT JOIN n USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars < 3 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 6 * n_lines
    OR 2 * n_shouts > n_words OR 10 * n_bullets > 9 * n_lines OR 10 * n_cut > 3 * n_lines) AS kept
FROM b
"""
