"""Lexical retrieval: BM25 and tiered matching, many queries in one pass over a corpus.

Scores follow the published Okapi form with K1 = 1.2 and B = 0.75, negated (lower is
better).  Texts are cut into words in the JVM; words meet the terms of a slice of
queries by Arrow's hash lookup, and scores are sparse sums.  Each task keeps the best
rows of each query, so what is shuffled grows with the queries, not with the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from .ranking import pool_size, relative, top_k

K1, B = 1.2, 0.75
#: Queries of one slice, documents of one block, and queries of one pass over the corpus.
QUERIES, BLOCK, PASS = 256, 2048, 32_768


def asked(queries: DataFrame) -> DataFrame:
    """query_id, term of each query (columns query_id, text)."""
    return queries.select("query_id", F.explode(T.query_terms(F.col("text"))).alias("term"))


def _spread(at: np.ndarray, which: np.ndarray, *columns: np.ndarray):
    """(entries at[w] to at[w + 1] for each w of which, columns repeated as often)."""
    n = at[which + 1] - at[which]
    return np.arange(n.sum()) + np.repeat(at[which] - np.cumsum(n) + n, n), [np.repeat(c, n) for c in columns]


class Slice:
    """The terms of some queries, which queries ask for each, and the words that match them."""

    def __init__(self, rows, tiers: bool):
        self.ids = sorted({r.query_id for r in rows})
        self.terms = sorted({r.term for r in rows})
        place, column = {t: k for k, t in enumerate(self.terms)}, {q: k for k, q in enumerate(self.ids)}
        asks = sorted({(place[r.term], column[r.query_id]) for r in rows})
        self.asks = np.array([q for _, q in asks], dtype=np.int64)
        self.asks_at = np.searchsorted(np.array([t for t, _ in asks], dtype=np.int64), np.arange(len(self.terms) + 1))
        self.n_terms = np.bincount(self.asks, minlength=len(self.ids))
        self.tiers = tiers
        if tiers:
            self.words: dict[str, list[int]] = {}
            for r in rows:
                for w in r.words:
                    if place[r.term] not in self.words.setdefault(w, []):
                        self.words[w].append(place[r.term])
            self.heads = {t: k for t, k in place.items() if len(t) >= 4 and t.isascii() and t.isalnum()}
            self.longest = max(map(len, self.heads), default=0)

    def matches(self, word: str) -> tuple[list[int], list[int]]:
        """Terms that a word matches by an inflection, and terms it begins with."""
        heads = (self.heads.get(word[:n]) for n in range(4, min(len(word), self.longest) + 1))
        return self.words.get(word, []), [k for k in heads if k is not None]

    def _per_query(self, doc, term, docs: int, weights=None):
        """Sum over a query's terms of the entries of each document: documents by queries."""
        e, (doc, *w) = _spread(self.asks_at, term, doc, *([] if weights is None else [weights]))
        return np.bincount(doc * len(self.ids) + self.asks[e], weights=w[0] if w else None, minlength=docs * len(self.ids)).reshape(docs, len(self.ids))

    def _tiers(self, words, of, docs: int):
        """0 where all terms match by inflections, 1 where they do by inflections or as beginnings, else 2."""
        coded = words.dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        found = [self.matches(w) for w in coded.dictionary.to_pylist()]
        seen = np.unique(of * max(1, len(found)) + np.asarray(coded.indices).astype(np.int64))
        doc, word = seen // max(1, len(found)), seen % max(1, len(found))
        tier = np.full((docs, len(self.ids)), 2, dtype=np.int64)
        pairs = np.zeros(0, dtype=np.int64)
        for k in (0, 1):
            at = np.cumsum([0, *(len(f[k]) for f in found)])
            flat = np.array([t for f in found for t in f[k]], dtype=np.int64)
            e, (d,) = _spread(at, word, doc)
            pairs = np.unique(np.append(pairs, d * len(self.terms) + flat[e]))
            all_ = self._per_query(pairs // len(self.terms), pairs % len(self.terms), docs) == self.n_terms
            tier[all_ & (tier == 2)] = k
        return tier

    def best_of(self, held, doc, term, weight, docs: int, words, of, ids, best: int):
        """held (query and tier, score, id), the best rows so far, with those of a block of documents."""
        total = self._per_query(doc, term, docs, weight)
        tier = self._tiers(words, of, docs) if self.tiers else np.full((1, 1), 2)
        hit = (total > 0) | (tier < 2)
        if held is not None and not self.tiers:  # what is behind the best so far does not come in
            hit &= total >= held[3]
        d, q = np.nonzero(hit)
        group, value, ids = q * 3 + (tier[d, q] if self.tiers else 2), np.round(-total[d, q], 9), ids.take(pa.array(d))
        if held is not None:
            group, value, ids = np.append(held[0], group), np.append(held[1], value), pa.concat_arrays([held[2], ids])
        order = np.lexsort((value, group))
        group, value = group[order], value[order]
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(begin, len(group)))
        least = np.zeros(len(self.ids))
        most = size >= best
        least[group[begin[most]] // 3] = -value[begin[most] + best - 1] - 1e-8
        last = np.repeat(value[begin + np.minimum(size, best) - 1], size) if len(begin) else value
        keep = value <= last  # ties with the last one are kept: ids decide later
        return group[keep], value[keep], ids.take(pa.array(order[keep])), least


class Slices:
    """Slices whose words are looked up together: each text is cut into words once for all of them."""

    def __init__(self, slices: list[Slice], groups: list | None):
        self.slices, self.groups = slices, groups  # groups: that of each slice
        self.terms = sorted(set().union(*(x.terms for x in slices)))
        self.known = pa.array(self.terms, pa.string())
        self.tiers = any(x.tiers for x in slices)
        place = {t: k for k, t in enumerate(self.terms)}
        self.local = []  # place in a slice of each term
        for x in slices:
            self.local.append(np.full(len(self.terms), -1, dtype=np.int32))
            self.local[-1][[place[t] for t in x.terms]] = np.arange(len(x.terms))

    def blocks(self, batches):
        """(block, lengths, words, document of each word) of blocks of documents."""
        for b in batches:
            for c in range(0, b.num_rows, BLOCK):
                some = b.slice(c, BLOCK)
                lists = some.column(1)
                n = np.asarray(pc.list_value_length(lists)).astype(np.int64)
                yield some, n, pc.ascii_lower(lists.flatten()), np.repeat(np.arange(len(n)), n)

    def entries(self, words, of):
        """(document, term, times) of a block's words that are terms."""
        term = pc.index_in(words, self.known)
        hit = np.flatnonzero(np.asarray(term.is_valid()))
        pair, n = np.unique(of[hit] * len(self.terms) + np.asarray(term.take(pa.array(hit))).astype(np.int64), return_counts=True)
        return pair // len(self.terms), pair % len(self.terms), n

    def count(self, batches):
        """Documents, words and documents with each term: rows (term, n), -1 and -2 for the first two."""
        df, docs, length = np.zeros(len(self.terms), dtype=np.int64), 0, 0
        for _, n, words, of in self.blocks(batches):
            docs, length = docs + len(n), length + int(n.sum())
            if len(self.terms):
                df += np.bincount(self.entries(words, of)[1], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append([-1, -2], some)), pa.array(np.append([docs, length], df[some]))], names=["term", "n"])

    def weigh(self, counts: dict[int, int]) -> None:
        self.n, self.mean = counts.get(-1, 0), counts.get(-2, 0) / max(1, counts.get(-1, 0))
        self.idf = np.array([math.log(1 + (self.n - counts.get(k, 0) + 0.5) / (counts.get(k, 0) + 0.5)) for k in range(len(self.terms))])

    def score(self, batches, best: int):
        """(query_id, id, bm25, tier) of the best rows of each query and tier."""
        held, known = [None] * len(self.slices), None if self.groups is None else sorted(set(self.groups))
        for block, n, words, of in self.blocks(batches):
            if not len(n):
                continue
            doc, term, times = self.entries(words, of)
            weight = self.idf[term] * times * (K1 + 1) / (times + K1 * (1 - B + B * n[doc] / max(self.mean, 1e-9)))
            own = np.zeros(len(n), dtype=np.int64) if known is None else np.asarray(pc.fill_null(pc.index_in(block.column(2), pa.array(known, block.column(2).type)), -1))
            for g in np.unique(own[own >= 0]).tolist():  # only documents of the query's group
                docs = np.flatnonzero(own == g)
                at, mine = np.cumsum(own == g) - 1, own[doc] == g
                d, t, w, ids = at[doc[mine]], term[mine], weight[mine], block.column(0).take(pa.array(docs))
                its = own[of] == g if self.tiers else None
                for k, one in enumerate(self.slices):
                    if known is None or self.groups[k] == known[g]:
                        local = self.local[k][t]
                        hit = np.flatnonzero(local >= 0)
                        held[k] = one.best_of(held[k], d[hit], local[hit].astype(np.int64), w[hit], len(docs), words.filter(pa.array(its)) if self.tiers else None, at[of[its]] if self.tiers else None, ids, best)
        for one, found in zip(self.slices, held):
            if found is not None and len(found[0]):
                names = pa.array(one.ids, self.kind)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(found[0] // 3)), found[2], pa.array(found[1]), pa.array(found[0] % 3)], names=["query_id", "id", "bm25", "tier"])


def scored(docs: DataFrame, queries: DataFrame, best: int, tiers: bool = False, group: str | None = None) -> DataFrame:
    """query_id, id, bm25, tier of each task's best rows of each query (and tier).

    docs: id, text; queries: query_id, text.  With `group`, a column of both, a query only
    finds documents of its own group; the statistics are those of all documents.  A pass over
    the corpus answers PASS queries, in slices of QUERIES, so what a task holds is bounded.
    """
    spark = docs.sparkSession
    terms = asked(queries)
    if tiers:
        terms = terms.withColumn("words", T.stems(F.col("term")))
    words = docs.select("id", F.coalesce(F.regexp_extract_all("text", F.lit(T.TOKEN), F.lit(0)), F.array().cast("array<string>")).alias("w"), *([group] if group else []))
    parts, out = queries.count() // PASS + 1, None
    schema = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(docs.dtypes)['id']}, bm25 double, tier long"
    for part in range(parts):
        mine = F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part
        rows: dict = {}
        for r in terms.filter(mine).collect():
            rows.setdefault(r.query_id, []).append(r)
        groups = {r.query_id: r[group] for r in queries.filter(mine).select("query_id", group).collect()} if group else dict.fromkeys(rows)
        sets: dict = {}
        for q in sorted(rows):
            if group is None or groups[q] is not None:
                sets.setdefault(groups[q], []).append(q)
        cut = [(g, qs[k : k + QUERIES]) for g, qs in sets.items() for k in range(0, len(qs), QUERIES)]
        one = Slices([Slice([r for q in qs for r in rows[q]], tiers) for _, qs in cut], [g for g, _ in cut] if group else None)
        counts = words.mapInArrow(one.count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        one.weigh({r.term: r.n for r in counts})
        one.kind = to_arrow_type(queries.schema["query_id"].dataType)
        sent = spark.sparkContext.broadcast(one)
        made = words.mapInArrow(lambda batches, sent=sent: sent.value.score(batches, best), schema)
        out = made if out is None else out.unionByName(made)
    return out


def bm25(docs: DataFrame, queries: DataFrame, best: int) -> DataFrame:
    """query_id, id, bm25 of documents that hold any term of the query; all that can be among the first
    `best` of their query (each task keeps its own)."""
    return scored(docs, queries, best).drop("tier")


def search(docs: DataFrame, queries: DataFrame, limit: int = 10, snippet_chars: int = 160) -> DataFrame:
    """The best documents of each query with rank, relative score and snippet."""
    best = top_k(bm25(docs, queries, limit), "query_id", [F.asc("bm25"), F.asc("id")], limit)
    best = best.withColumn("best", F.min("bm25").over(Window.partitionBy("query_id")))
    rows = best.join(docs.select("id", F.col("text").alias("content")), "id").join(queries.select("query_id", T.query_terms(F.col("text")).alias("terms")), "query_id")
    return rows.select("query_id", "id", "rank", F.round("bm25", 6).alias("bm25"), F.round(relative(F.col("bm25"), F.col("best")), 6).alias("score"), T.snippet(F.col("content"), F.col("terms"), snippet_chars).alias("snippet"))


def tiered(docs: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """Strict AND (each term or an inflection of it), filled up by prefixes while there are
    fewer than `limit`, and OR where nothing was found: query_id, id, tier, bm25, rank.

    A document keeps its first tier; tier beats score.
    """
    first = scored(docs, queries, pool_size(limit), tiers=True)
    per = Window.partitionBy("query_id")
    t0, t1 = (F.count_if(F.col("tier") == k).over(per) for k in (0, 1))
    first = first.withColumn("t0", t0).withColumn("t1", t1)
    keep = (F.col("tier") == 0) | ((F.col("tier") == 1) & (F.col("t0") < limit)) | ((F.col("tier") == 2) & (F.col("t0") + F.col("t1") == 0))
    return top_k(first.filter(keep).select("query_id", "id", "tier", "bm25"), "query_id", [F.asc("tier"), F.asc("bm25"), F.asc("id")], pool_size(limit))
