import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from mnemospark.llm import op6_packing as op


def test_hilbert_neighbours():
    points = np.array(list(itertools.product(range(8), repeat=3)))
    key = op.hilbert(points, 3)
    assert sorted(key) == list(range(512))
    walk = points[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def check(rows, pieces):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((str(d), tuple(tok.encode(t or "", add_special_tokens=False).ids + [1])) for d, t in rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[str(p.doc_id)].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for d, ids in want:
        if sum(x[0] == d for x in want) == 1:
            at = 0
            for p in sorted(by_doc[d], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
                at += p.length
            assert at == len(ids)
    for d in {d for d, _ in want}:  # of rows that share an id: all places of all, whichever the row
        places = sorted((p.doc_tokens, x) for p in by_doc[d] for x in range(p.start, p.start + p.length))
        assert places == sorted((len(i), x) for e, i in want if e == d for x in range(len(i)))
    assert sum(p.length for p in pieces) == sum(len(i) for _, i in want)
    for spans in by_sequence.values():
        end = 0
        for offset, n in sorted(spans):
            assert offset == end and n > 0
            end += n
        assert end <= 2048 and (end == 2048 or end & (end - 1) == 0)


def test_sequences_follow_the_curve(spark, sf):
    """Documents start in the order of their keys along the sequences, and copies lie together."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    tok, matrix = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), op.projection()
    rows = docs.collect()
    ids = [np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], dtype="<u4") for r in rows]
    keys = dict(zip([r.doc_id for r in rows], op.curve_keys(ids, matrix).tolist()))
    pieces = op.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1).collect()
    walk = [(keys[p.doc_id], p.doc_id, p.start) for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset))]
    assert walk == sorted(walk)


def test_special_token_strings(spark):
    rows = [(1, "hello <|endoftext|> world"), (2, "<|startoftext|><|endoftext|>"), (3, "a <|ENDOFTEXT|> b<|endoftext|>")]
    check(rows, op.pack(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), 1).collect())


def test_query_whole_table(spark, sf):
    check([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()], op.op6_curve_packing(spark, sf).collect())


def test_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "a b", 0), (3, "x " * 100_000, 0), (4, "same text", 0), (4, "same text", 1), (5, "tab\tand  spaces É", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    path = public_tokenizers.path("word_bpe_49k.json")
    check([r[:2] for r in rows], op.pack(docs, path, 1).collect())
    assert op.pack(docs.limit(0), path, 1).count() == 0
    assert all(len(r.ids) == 4 * r.length for r in op.pack(docs, path, 1, keep_ids=True).collect())
