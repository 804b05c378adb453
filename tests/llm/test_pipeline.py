import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
from test_op1 import brute_score
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mnemospark.llm import op1_decontaminate, op5_quality, op8_pii, op9_simhash


def brute_classes(texts):
    """The least id of each class linked by Jaccard 0.8 of the sets of five-word shingles."""
    sets = {}
    for d, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d for d in texts if find(d) == d}


def test_run_against_brute_force(spark, sf):
    from test_op5 import by_sql
    from test_op8 import base

    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kept = {int(x[1:].split(",")[0]) for x in by_sql([list(r) for r in rows.items()]) if x.endswith("True)")}
    kept = brute_classes({d: rows[d] for d in kept})
    items = [op1_decontaminate.words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for d in sorted(kept):
        words = op1_decontaminate.words_of(rows[d])
        for item in items:
            if 2 * sum((Counter(item) & Counter(words)).values()) >= len(item) and brute_score(item, words) >= len(item):
                kept.discard(d)
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == kept
    skipped = 0
    tok, left = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for r in got:
        left[r.doc_id] += r.length
    for d in kept:
        text, end, out = rows[d], 0, ""
        spans = base(text)
        further = [(m.start(), m.end(), k.upper()) for k in ("iban", "national_id", "local_phone") for m in re.finditer(op8_pii.PATTERN[k].replace("\\x20", " "), text)]
        if further:  # which of them count: in test_op8, against a reading of its own
            skipped += 1
            continue
        for s, _, e, kind in spans:
            if s >= end:
                out += text[end:s] + f"[{kind.upper()}]"
            end = max(end, e)
        assert left[d] == len(tok.encode(out + text[end:], add_special_tokens=False).ids) + 1
    assert 2 * skipped < len(kept)


def test_stages_keep_columns_and_survive_edges(spark, sf):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good, "en", "s", 1, "k"), (1, good, "en", "s", 1, "k"), (None, good, None, None, None, None), (None, "only " + good[::-1], None, None, None, None), (None, "only " + good[::-1], None, None, None, None), (2, None, None, None, None, None), (3, "", "", "", 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string").withColumn("a.b", F.lit(1)).withColumn("_root", F.lit(2)).withColumn("_TEXT", F.lit(3))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "fp", "a.b", "_root", "_TEXT"]
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "None"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], docs.schema), sf).count() == 0


def test_keep_one_of_equal_ids_with_other_texts(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "q r s t u v w"), (5, "a b c d e f")], "doc_id long, text string")
    assert op9_simhash.keep_one(docs).count() == 2
    assert op5_quality.filter_documents(docs).count() == 0


def test_packing_keeps_few_words_in_a_worker(monkeypatch):
    from mnemospark.llm import op6_packing, shared, wordcache

    path = public_tokenizers.path("word_bpe_49k.json")
    wordcache.load(path, 1000).encode("some words")
    shared.trim(path)
    assert (path, 1000) in wordcache._LOADED
    shared.trim()
    assert not wordcache._LOADED
    seen = []
    monkeypatch.setattr(op6_packing, "pack", lambda *a, **b: seen.append(b))
    corpus_pipeline.packing(None, None, "")
    assert seen[0]["cache"] <= 100_000
