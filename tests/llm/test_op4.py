import hashlib
import itertools
import random
from collections import Counter

import pytest

from mnemospark.llm import op4_repeats as op


def brute(rows, length=op.LENGTH):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def test_query_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(str, map(tuple, op.op4_repeated_bytes(spark, sf).collect()))) == brute(rows)


@pytest.mark.parametrize("piece, hot", [(1 << 20, 1 << 20), (700, 1 << 20), (4096, 2)])
def test_edited_copies(spark, monkeypatch, piece, hot):
    monkeypatch.setattr(op, "PIECE", piece)
    monkeypatch.setattr(op, "HOT", hot)  # 2: nearly every key that recurs is split
    monkeypatch.setattr(op, "SHARE", 64 if hot > 2 else 1)
    r = random.Random(piece)
    letters = lambda n, abc="abcdefgh ": "".join(r.choice(abc) for _ in range(n))
    base = [letters(900), "x" * 450, "ab" * 300, letters(230, "ab"), "é" * 150]
    rows = [(1, None), (2, ""), (3, "q" * 199), (None, letters(300))]
    for k in range(60):
        t = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            t[r.randrange(len(t))] = r.choice("XYZ")
        cut = r.randint(0, 150)
        rows.append((k % 50, letters(r.randint(0, 90)) + "".join(t[cut:]) + letters(r.randint(0, 90))))
    rows += [(7, base[0]), (7, base[0]), (8, letters(30_000)), (9, base[0][:200])]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, rid int").repartition(5)
    assert sorted(map(str, map(tuple, op.remove_repeats(docs).collect()))) == brute(rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.remove_repeats(docs).count() == 0


def test_one_text_of_fifty_megabytes(spark):
    """Passages planted far apart in one text, over the borders of its pieces."""
    import numpy as np

    r = np.random.default_rng(5)
    text = r.integers(97, 123, 50_000_000, dtype=np.uint8)
    text[0::7] = 32
    for k, at in enumerate((op.PIECE - 150, 3 * op.PIECE - 1, 20_000_000, 47 * op.PIECE - 299)):
        text[at : at + 300 + k] = text[1_500_000 : 1_500_300 + k]
    want = np.zeros(len(text), dtype=bool)
    places = [1_500_000, op.PIECE - 150, 3 * op.PIECE - 1, 20_000_000, 47 * op.PIECE - 299]
    for a, b in itertools.permutations(places, 2):  # each pair's common run, with what agrees by chance around it
        x, y = (text[p - 50 : p + 400] for p in (a, b))
        differ = np.flatnonzero(x != y)
        start, stop = differ[differ < 50].max(initial=-1) + 1, differ[differ >= 50].min()
        want[a - 50 + start : a - 50 + stop] = True
    docs = spark.createDataFrame([(1, text.tobytes().decode())], "doc_id long, text string")
    got = op.remove_repeats(docs, keep_text=True).first()
    assert got.n_bytes == len(text) and got.n_removed == int(want.sum()) and got.n_spans == 5
    assert got.kept == text[~want].tobytes()
