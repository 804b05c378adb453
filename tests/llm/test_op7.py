from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mnemospark.llm import op7_token_counts as op


def test_query_against_brute_force(spark, sf):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    want = Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        x = labels.get(r.doc_id)
        if x and x.toxic == 1:
            continue
        more = int(bool(x and x.quality == 0))
        for name, n in (("words-1", len((r.text or "").encode().split())), ("byte_bpe_50k-1", len(tok.encode(r.text or "", add_special_tokens=False).ids))):
            want[r.source, r.lang, name, "docs"] += 1
            want[r.source, r.lang, name, "tokens"] += n + more
    got = Counter()
    for r in op.op7_token_counts(spark, sf).collect():
        got[r.source, r.lang, r.tokenizer, "docs"] += r.n_docs
        got[r.source, r.lang, r.tokenizer, "tokens"] += r.n_tokens
    assert got == want


def test_batches(spark, tmp_path):
    store = op.TokenCounts(spark, str(tmp_path / "s"))
    assert store.totals().count() == 0
    cols = "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_docs int"
    rows = lambda *r: spark.createDataFrame([(*x, 9) for x in r], cols)
    assert store.apply("a", inserts=rows((1, "s", "en", "t", 10), (1, "s", "en", "t", 10), (None, None, None, "t", None), (2, "s", "en", "t", 5)))
    assert not store.apply("a", inserts=rows((3, "s", "en", "t", 99)))
    total = lambda: {tuple(r)[:3]: (r.n_docs, r.n_tokens) for r in store.totals().collect()}
    assert total() == {("s", "en", "t"): (3, 25), (None, None, "t"): (1, 0)}
    assert store.apply("b", revised=rows((1, "s2", "en", "t", 7)), deletes=spark.createDataFrame([(None,), (77,)], "doc_id long"))
    assert total() == {("s", "en", "t"): (1, 5), ("s2", "en", "t"): (1, 7)}
    assert store.apply("empty") and total() == {("s", "en", "t"): (1, 5), ("s2", "en", "t"): (1, 7)}
    with pytest.raises(ValueError):
        store.apply("x/y")


def test_two_writers(spark, tmp_path, monkeypatch):
    rows = lambda *r: spark.createDataFrame(r, "doc_id long, source string, lang string, tokenizer string, n_tokens long")
    a, b = (op.TokenCounts(spark, str(tmp_path / "s")) for _ in range(2))
    listed, stale = b.committed, [{}]
    b.committed = lambda: stale.pop() if stale else listed()
    assert a.apply("x", inserts=rows((1, "s", "en", "t", 10)))
    assert not b.apply("x", inserts=rows((1, "s", "en", "t", 99)))  # had read the log before a wrote it
    assert a.totals().first().n_tokens == 10 and list(listed()) == ["x"]
    gone = spark.createDataFrame([(1,)], "doc_id long")
    stale.append(listed())
    assert a.apply("y", deletes=gone)
    assert b.apply("z", deletes=gone)  # starts over and finds nothing left to delete
    assert a.totals().count() == 0 and list(listed()) == ["x", "y", "z"]
    assert a._commit(1, "w", "lost") is False


def test_special_token_strings(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["hello <|endoftext|> world", "<|endoftext|><|endoftext|>", "x<|endoftext|>y\n<|endofte"]
    docs = spark.createDataFrame([(k, t, "s", "en") for k, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r.n_tokens for r in op.counts(docs, {"t": path}).collect()}
    assert got == {k: len(tok.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}


def test_broken_off_batch_counts_nothing(spark, tmp_path):
    store = op.TokenCounts(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([(1, "s", "en", "t", 10)], "doc_id long, source string, lang string, tokenizer string, n_tokens long")
    rows.withColumn("n_docs", rows.n_tokens).write.parquet(str(tmp_path / "s/batches/a@lost/ledger"))
    assert store.totals().count() == 0
    assert store.apply("a", inserts=rows) and store.totals().first().n_tokens == 10
