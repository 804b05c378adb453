import io
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mnemospark.llm import op3_token_files as op


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 1 << 17), st.integers(0, (1 << 64) - 1)), max_size=3000))
@settings(max_examples=60, deadline=None)
def test_round_trip(values):
    words, starts, far = op.encode(np.array(values, dtype=np.uint64))
    assert op.decode(words, starts, far, len(values)).tolist() == values


def test_group_round_trip():
    ids = [np.arange(k, dtype="<u4").tobytes() for k in (0, 5, 3000, 1)]
    out = io.BytesIO()
    out.write(op.MAGIC)
    op.write_group(out, [3, None, 5, 7], ids)
    op.write_group(out, [8], [b""])
    out.seek(0)
    (a, nulls, n, flat), (b, _, m, none) = op.read_groups(out)
    assert n.tolist() == [0, 5, 3000, 1] and nulls.tolist() == [0, 1, 0, 0] and flat.tobytes() == b"".join(ids)
    assert b.tolist() == [8] and m.tolist() == [0] and len(none) == 0


def test_group_of_large_ids():
    ids = np.array([5, 1 << 31, 7, 5, 4_000_000_000], dtype="<u4").tobytes()
    out = io.BytesIO()
    out.write(op.MAGIC)
    op.write_group(out, [1], [ids])
    out.seek(0)
    ((_, _, _, flat),) = op.read_groups(out)
    assert flat.tobytes() == ids


def _expected(rows):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_query_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, op.op3_token_files(spark, sf).collect()))
    assert got == _expected(rows)


def test_edges(spark, tmp_path):
    rows = [(5, None, 1), (None, "x", 1), (5, "b  c\t d\n\n é", 1), (5, "", 2), (1, " lead", 0), (1, " lead", 0), (2, "word " * 30000, 0), (9, "日本\x1c a", 0), (10, "hello <|endoftext|> world", 0), (11, "<|endoftext|><|endoftext|>\nx<|endoftext|>", 0), (12, "<|endofte xt|>", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    m = op.write_token_files(docs, f"{tmp_path}/a", public_tokenizers.path("byte_bpe_50k.json"), 2)
    got = [tuple(r) for r in op.read_token_files(m).orderBy("start").collect()]
    assert got == _expected([r[:2] for r in rows])
    none = op.write_token_files(docs.limit(0), f"{tmp_path}/b", public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert op.read_token_files(none).count() == 0


def test_white_space_is_found_where_the_text_is_cut():
    """Pairs of white space take no search of their own, and give the library's ids."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, plain = op.wordcache.load(path, 1000), Tokenizer.from_file(path)
    assert not {"  ", "\n\n", " \n", "\n "} & set(tok.odd) and op.CACHE > op.wordcache.CACHE
    for text in ("a  b", "a\n\nb.", "a \nb", "a\n b, c", "É.\n É", "a b\n\n\nc", "ʒe, ª. a.", "word,\nword, word"):
        assert np.frombuffer(tok.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
