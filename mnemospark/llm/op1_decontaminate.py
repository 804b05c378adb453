"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. The n-grams of the test items (N = 1: words) are counted over all training documents
   (document frequency; only the items' own are counted, so the counts are no larger than
   the benchmark).
2. Seeds: an alignment that reaches the threshold matches m = ceil(threshold * L) words of
   an item's L at least.  Of the item's L - m + k rarest places (k = HITS, or less in a short
   item) it therefore matches k at least.  Those places are the seeds.
3. A document's words are looked up in the seeds.  The gaps of such an alignment are
   2 * (1 - threshold) * L at most, so k hits whose diagonals lie that close together mark
   a window that holds every alignment through them; it is aligned with the item by
   Smith-Waterman on words (match 2, mismatch -1, gap -1), unless its words could not reach
   the threshold even if all in order.  similarity = score / (2 * words of the item).
   No step loses a document: results equal exhaustive alignment.

The benchmark is held by every task while its text is at most MOST_BYTES; a larger
one is worked off in slices, one at a time, each against all documents.

Defined cases: null or empty texts and items match nothing; items under
SHORTEST words match nothing; repeated documents are each reported; equal items are
each reported; of equally good places the first found is reported; a text of any length is
searched whole (about 40 bytes of memory a word); an empty side gives an empty result;
further columns are ignored, or passed through by decontaminate().
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SHORTEST, THRESHOLD, HITS, MOST_BYTES = 3, 0.5, 4, 32 << 20
PUNCTUATION = ".,;:!?\"'()[]{}<>|*#%&$-_/\\«»“”‘’…"
FOUND = "doc_id long, item_id long, score long, item_words long, similarity double, start_word long, end_word long"
_ASCII = {ord(c): " " for c in PUNCTUATION if c.isascii()}
_BYTES = bytes(32 if b in _ASCII else b for b in range(256))
_FURTHER = [c for c in PUNCTUATION if not c.isascii()]


def words_of(text: str | None) -> list[str]:
    """Lower-case words; punctuation counts as white space."""
    text = (text or "").lower()
    if text.isascii():
        return text.translate(_ASCII).split()
    text = text.encode("utf-8", "surrogatepass").translate(_BYTES).decode("utf-8", "surrogatepass")
    for c in _FURTHER:
        if c in text:
            text = text.replace(c, " ")
    return text.split()


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of the item with each row of windows, and its end (exclusive)."""
    n, width = windows.shape
    lane = np.arange(width)
    above = np.zeros((n, width + 1), dtype=np.int64)
    best, end = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for word in item:
        row = np.maximum(above[:, :-1] + np.where(windows == word, 2, -1), above[:, 1:] - 1)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + lane, axis=1) - lane  # gaps along the row
        top = row.argmax(axis=1)
        score = row[np.arange(n), top]
        better = score > best
        best[better], end[better] = score[better], top[better] + 1
        above[:, 1:] = row
    return best, end


def joined(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries at[r] to at[r + 1] of each of rows, one after the other, and how many each has."""
    n = at[rows + 1] - at[rows]
    return np.arange(n.sum()) + np.repeat(at[rows] - np.cumsum(n) + n, n), n


class Index:
    """Items of a benchmark, their words and, once counted, their seeds.  Equal items are one."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.vocabulary: dict[str, int] = {}
        keys: dict[tuple, list] = {}
        for key, text in items:
            words = words_of(text)
            if len(words) >= SHORTEST:
                keys.setdefault(tuple(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words), []).append(key)
        self.keys = list(keys.values())
        self.items = [np.array(x, dtype=np.int64) for x in keys]
        self.bags = [Counter(x) for x in keys]

    def seed(self, frequency: np.ndarray, threshold: float) -> None:
        """Take each item's rarest words as seeds; frequency: documents with each word."""
        seeds, self.hits = [], []
        for k, item in enumerate(self.items):
            spare = len(item) - math.ceil(threshold * len(item))
            self.hits.append(max(1, min(HITS, len(item) - spare)))
            rare = np.argsort(frequency[item], kind="stable")[: spare + self.hits[-1]]
            seeds += [(int(item[i]), k, int(i)) for i in rare if frequency[item[i]]]
        self.hits = np.array(self.hits, dtype=np.int64)
        self.slack = np.array([math.ceil(2 * (1 - threshold) * len(x)) for x in self.items], dtype=np.int64)
        seeds.sort()
        self.seed_item, self.seed_offset = (np.array([x[j] for x in seeds], dtype=np.int64) for j in (1, 2))
        self.seed_at = np.searchsorted(np.array([w for w, _, _ in seeds], dtype=np.int64), np.arange(len(self.vocabulary) + 1))
        self.is_seed = np.append(np.diff(self.seed_at) > 0, False)  # id -1 is the last entry, of no word

    def ids(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def find(self, text: str | None, threshold: float) -> list[tuple]:
        """(item key, score, item words, similarity, start word, end word), the best place of each item."""
        ids = self.ids(text)
        hit = np.flatnonzero(self.is_seed[ids])
        if not len(hit):
            return []
        entry, n = joined(self.seed_at, ids[hit])
        which, begin = self.seed_item[entry], np.repeat(hit, n) - self.seed_offset[entry]
        order = np.lexsort((begin, which))
        which, begin = which[order], begin[order]
        last = np.arange(len(which)) + self.hits[which] - 1
        one = np.flatnonzero(last < len(which))
        one = one[(which[last[one]] == which[one]) & (begin[last[one]] - begin[one] <= self.slack[which[one]])]
        which, first, last = which[one], begin[last[one]] - self.slack[which[one]], begin[one] + self.slack[which[one]]
        out = []
        for k in np.unique(which).tolist():
            item, bag = self.items[k], self.bags[k]
            need, slack = threshold * 2 * len(item), int(self.slack[k])
            spans: list[tuple[int, int]] = []
            for a, z in zip(np.maximum(first[which == k], 0).tolist(), np.minimum(last[which == k] + len(item), len(ids)).tolist()):
                if spans and a <= spans[-1][1] and z - spans[-1][0] <= 2 * (len(item) + 2 * slack):
                    spans[-1] = (spans[-1][0], max(z, spans[-1][1]))
                else:
                    spans.append((a, z))
            spans = [(a, z) for a, z in spans if 2 * sum((bag & Counter(ids[a:z].tolist())).values()) >= need]
            if not spans:
                continue
            width = max(z - a for a, z in spans)
            best = (0, 0, 0)
            for c in range(0, len(spans), 256):
                grid = np.full((len(spans[c : c + 256]), width), -2, dtype=np.int64)
                for row, (a, z) in enumerate(spans[c : c + 256]):
                    grid[row, : z - a] = ids[a:z]
                score, end = align(item, grid)
                top = int(score.argmax())
                if score[top] > best[0]:
                    best = (int(score[top]), spans[c + top][0] + int(end[top]), spans[c + top][0])
            score, end, at = best
            if score >= need and score:
                back, length = align(item[::-1], ids[at:end][::-1][None, :])
                out += [(key, score, len(item), score / (2 * len(item)), end - int(length[0]), end) for key in self.keys[k]]
        return out


def slices(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text"):
    """The items, in lists of at most about MOST_BYTES of text, collected one at a time."""
    items = benchmark.select(F.col(item_col).cast("long").alias("k"), shared.quoted(text_col).cast("string").alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = total // MOST_BYTES + 1
    part = F.pmod(F.xxhash64("k", "t"), F.lit(parts))
    for p in range(parts):
        yield sorted(((r.k, r.t) for r in items.filter(part == p).collect()), key=lambda r: (r[0] is None, r[0], r[1] or ""))


def seeded(docs: DataFrame, items: list[tuple], threshold: float, text_col: str = "text") -> Index:
    """An index with seeds by the document frequencies over all of docs."""
    spark = docs.sparkSession
    index = Index(items)
    sent = spark.sparkContext.broadcast(index)

    def count(batches):
        own = sent.value
        df = np.zeros(len(own.vocabulary), dtype=np.int64)
        for b in batches:
            for text in b.column(0):
                ids = own.ids(text.as_py())
                df[np.unique(ids[ids >= 0])] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["word", "n"])

    frequency = np.zeros(len(index.vocabulary), dtype=np.int64)
    if len(frequency):
        found = docs.select(shared.quoted(text_col).cast("string")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        for r in found.collect():  # at most as many as the slice of the benchmark has words
            frequency[r.word] = r.n
    sent.destroy()
    index.seed(frequency, threshold)
    return index


def _by_slice(docs: DataFrame, benchmark: DataFrame, threshold: float, text_col: str):
    """(broadcast index, whether it is the only one) of each slice of the benchmark."""
    found = slices(benchmark)
    now = next(found)
    only = True
    while now is not None:
        after = next(found, None)
        only = only and after is None
        yield docs.sparkSession.sparkContext.broadcast(seeded(docs, now, threshold, text_col)), only
        now = after


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and item that it holds: score, similarity and place (in words)."""
    rows = docs.select(shared.quoted(id_col).cast("long").alias("doc_id"), shared.quoted(text_col).cast("string").alias("text"))
    out = None
    for sent, only in _by_slice(docs, benchmark, threshold, text_col):

        def search(batches, sent=sent):
            for b in batches:
                found = [(key, *f) for key, text in zip(b.column(0).to_pylist(), b.column(1)) for f in sent.value.find(text.as_py(), threshold)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 4 else pa.int64()) for k, c in enumerate(zip(*found))], names=[x.split(" ")[0] for x in FOUND.split(", ")])

        made = rows.mapInArrow(search, FOUND)
        if not only:  # the driver holds one slice at a time
            made = shared.stored(made, "contaminated")
            sent.destroy()
        out = made if out is None else out.unionByName(made)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    at, whole = docs.columns.index(text_col), docs
    for sent, only in _by_slice(whole, benchmark, threshold, text_col):

        def clean(batches, sent=sent):
            shared.trim()
            for b in batches:
                yield b.filter(pa.array([not sent.value.find(t.as_py(), threshold) for t in b.column(at)], pa.bool_()))

        docs = shared.mapped(docs, clean)
        if not only:
            docs = shared.stored(docs, "decontaminated")
            sent.destroy()
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
