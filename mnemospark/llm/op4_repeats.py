r"""Suffix-array deduplication by prefix-free parsing.

Which bytes stand in a string of LENGTH bytes that also starts elsewhere?  In the
suffix array of the corpus these are the suffixes whose neighbour shares LENGTH bytes.
Prefix-free parsing finds that order from a dictionary and a parse:

* Triggers: a rolling hash over W bytes is 0 modulo P.  A cut behind each trigger makes
  phrases; wherever a string recurs, its inner cuts recur at the same places.  A phrase
  too long for a cut within reach is cut where its rolling hash is least.
* A suffix is (rest of its phrase, the phrases that follow).  Suffixes agree on LENGTH
  bytes only if their first inner cut is equally far off and what stands around that
  cut agrees.  So all suffixes that begin before one cut are handled as one entry.
* Only the classes of suffixes that agree on LENGTH bytes are needed, not the order of
  the classes.  Phrase rests and continuations are therefore named by 128-bit hashes
  instead of ranks, and sorting the entries by name stands for the merge of the two
  suffix arrays; it distributes, and needs no array over the whole corpus.

Entry of a cut c: key 1 names the bytes around the cut that all its suffixes hold, key
2 names the whole region they reach.  Sorted by (key 1, key 2), a scan tells:
  full     the region recurs: all its suffixes are repeated;
  partial  only the bytes around the cut recur: its suffixes are looked at more closely,
           together with those of one region of every full class at that key;
  none     the cut's bytes occur once, and so do all its suffixes.
Closer looks: first in blocks of BLOCK suffixes, named in the same way by the bytes that
all of a block hold and by their region, then suffix by suffix.  In text without repeats
nearly every entry is `none`, which is what the parse is for.

Entries of a name that a task holds more than once are merged before the shuffle, so
a hot name has at most one row per task's piece of text; the scans keep one entry.
Texts are written once, compressed, a file for each task of the first pass; later
passes send the few places to the files instead of shuffling the texts.

Defined cases: null text is empty (no bytes, nothing removed, digest of nothing); texts
under LENGTH bytes are untouched; rows of equal or null doc_id are rows of their own; a text
is held whole by its task (three times its bytes at most) and worked in pieces of PIECE
bytes, about 150 bytes of memory for each of a piece; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LENGTH, W, P, AROUND, BLOCK = 200, 12, 64, 48, 16
#: Bytes of a piece of texts, and bits that hold any place in one.
PIECE, PLACE = 1 << 20, np.uint64(24)
#: A key of more entries than HOT is split; it is looked for in one of SHARE texts.
HOT, SHARE = 1 << 20, 64
#: A place: first suffix << 32, bytes from it to its cut << 24, number of suffixes << 2, weight (1 or 2).
RUN = 1 << 21
ENTRY = "k1 long, k2 long, rid long, pos long"
KEYS = "k1 long, n long, x long, y long"
FULL, PARTIAL, SAMPLE = 0, 1, 2


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


class Hash:
    """Hashes of any substring of a buffer, from sums of byte value * base ** place modulo 2 ** 64."""

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        self.table = r.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(r.integers(1 << 61, 1 << 62)) * 8 + 5
        self.power = self.inverse = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) <= n:
            size = max(n + 1, PIECE + 1)
            with np.errstate(over="ignore"):
                both = []
                for b in (self.base, pow(self.base, -1, 1 << 64)):
                    x = np.full(size, b & (2**64 - 1), dtype=np.uint64)
                    x[0] = 1
                    both.append(np.multiply.accumulate(x))
            self.power, self.inverse = both

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.table[data] * self.power[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((sums[end] - sums[begin]) * self.inverse[begin])


_HASHES: list[Hash] = []


def hashes() -> list[Hash]:
    if not _HASHES:
        _HASHES.extend([Hash(20240), Hash(71)])
    return _HASHES


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All places of each run."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of x[i : i + size] for each i; what is beyond the end counts as greatest."""
    n = len(x)
    blocks = -(-n // size) + 1
    grid = np.full(blocks * size, np.iinfo(x.dtype).max, dtype=x.dtype)
    grid[:n] = x
    grid = grid.reshape(blocks, size)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[size - 1 : size - 1 + n])


def parse(data: np.ndarray, offsets: np.ndarray):
    """Entries of the texts data[offsets[i]:offsets[i+1]]: key 1, key 2, text number, first suffix,
    number of suffixes, bytes from the first suffix to the cut."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < LENGTH:
        return (none.view(np.uint64), none.view(np.uint64), none, none, none, none)
    a, b = hashes()
    sa, sb = a.sums(data), b.sums(data)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(data) - W + 1)  # a cut at c has its trigger at c - W
    rolling = a.of(sa, at, at + W)
    inside = text[at] == text[at + W - 1]
    far = np.int64(1 << 62)
    trigger = np.where(inside & (rolling < np.uint64((1 << 64) // P)), at, far)
    coming = np.minimum.accumulate(trigger[::-1])[::-1]
    start = np.arange(len(data) - LENGTH + 1)
    start = start[text[start] == text[start + LENGTH - 1]]
    reach = LENGTH - W - AROUND
    # 40 bits of hash, then the place: the choice is the same in whatever piece the bytes stand.
    key = np.where(inside, (rolling >> PLACE) << PLACE, np.uint64(2**64 - 1) >> PLACE << PLACE) | at.astype(np.uint64)
    least = (_sliding_min(key, reach + 1)[start] & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
    cut = np.where(coming[start] <= start + reach, coming[start], least) + W
    if not len(start):
        return (none.view(np.uint64), none.view(np.uint64), none, none, none, none)
    new = np.flatnonzero(np.append(True, (cut[1:] != cut[:-1]) | (start[1:] != start[:-1] + 1) | (text[start[1:]] != text[start[:-1]])))
    first, last, c = start[new], start[np.append(new[1:], len(start)) - 1], cut[new]
    k1 = a.of(sa, c - W, c + AROUND)
    k2 = _mix(b.of(sb, first, last + LENGTH) + (last - first).astype(np.uint64))
    return k1, k2, text[first], first - offsets[text[first]], last - first + 1, c - first


def merged(k1, k2, rid, first, count, off):
    """Entry rows.  Of entries with one name only the first goes by it, marked as repeated; the
    others are known to be repeated, are joined to runs and get names of their own."""
    order = np.lexsort((k2, k1))
    k1, k2, rid, first, count, off = (x[order] for x in (k1, k2, rid, first, count, off))
    new = np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))
    size = np.diff(np.append(np.flatnonzero(new), len(k1)))
    pos = first[new] << 32 | off[new] << 24 | count[new] << 2 | np.where(size > 1, 2, 1)
    r, f, n = rid[~new], first[~new], count[~new]
    o = np.lexsort((f, r))
    r, f, n = r[o], f[o], n[o]
    parts = [(k1[new], k2[new], rid[new], pos)]
    if len(r):
        head = np.append(True, (r[1:] != r[:-1]) | (f[1:] != f[:-1] + n[:-1]) | (f[1:] // RUN != f[:-1] // RUN))
        at = np.flatnonzero(head)
        total = np.add.reduceat(n, at)
        own = _mix(_mix(r[at].astype(np.uint64)) + f[at].astype(np.uint64))
        parts.append((own, _mix(own), r[at], f[at] << 32 | (total << 2) | 2))
    k1, k2, rid, pos = (np.concatenate(x) for x in zip(*parts))
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in (k1, k2, rid, pos)], names=["k1", "k2", "rid", "pos"])


def unpacked(pos: np.ndarray):
    """First suffix, number of suffixes, bytes to the cut (runs have none and are never looked at closely)."""
    return pos >> 32, pos >> 2 & 0x3FFFFF, pos >> 24 & 0xFF


def pieces(rows, more: int):
    """(data, offsets, rids, bases, places) of consecutive texts (rid, doc_id, z, places), about PIECE bytes
    at a time.  A longer text comes in parts that begin at its bytes `bases`, PIECE apart; each has `more`
    bytes of the next.  Places, where there are any, are those that begin in the part."""
    texts, rids, bases, places, size = [], [], [], [], 0

    def joined():
        return np.frombuffer(b"".join(texts), dtype=np.uint8), np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64), np.array(rids, dtype=np.int64), np.array(bases, dtype=np.int64), places

    for rid, _, z, pos in rows:
        text = zlib.decompress(z)
        for base in range(0, max(1, len(text)), PIECE):
            texts.append(text[base : base + PIECE + more])
            rids.append(rid)
            bases.append(base)
            places.append(pos if pos is None or len(text) <= PIECE else pos[(pos >> 32) // PIECE == base // PIECE])
            size += len(texts[-1])
            if size >= PIECE:
                yield joined()
                texts, rids, bases, places, size = [], [], [], [], 0
    if texts:
        yield joined()


def _entries(rows):
    for data, offsets, rids, bases, _ in pieces(rows, LENGTH - 1):
        k1, k2, t, first, *rest = parse(data, offsets)
        if len(k1):
            yield merged(k1, k2, rids[t], first + bases[t], *rest)


def _some_keys(look):
    """k1, n, and the least and greatest k2 of the entries of one of SHARE texts."""

    def run(rows):
        for b in look(r for r in rows if zlib.crc32(r[0].to_bytes(8, "little")) % SHARE == 0):
            k1, k2 = (np.asarray(b.column(k)) for k in range(2))
            at = np.flatnonzero(np.append(True, k1[1:] != k1[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[at], np.diff(np.append(at, len(k1))), np.minimum.reduceat(k2, at), np.maximum.reduceat(k2, at))], names=["k1", "n", "x", "y"])

    return run


def _closer(block: int):
    """Entries of `block` suffixes each for the places of the texts; of single suffixes for block = 1."""

    def run(rows):
        for data, offsets, rids, bases, places in pieces((r for r in rows if r[3] is not None), 1024):
            if not sum(map(len, places)):
                continue
            a, b = hashes()
            sa, sb = a.sums(data), b.sums(data)
            first, count, off = unpacked(np.concatenate(places))
            begin = np.repeat(offsets[:-1] - bases, [len(x) for x in places]) + first
            at = _runs(begin, count)
            cut = np.repeat(begin + off, count)
            at, once = np.unique(at, return_index=True)
            cut = cut[once]
            t = np.searchsorted(offsets, at, side="right") - 1
            if block == 1:
                one = np.ones(len(at), dtype=np.int64)
                yield merged(a.of(sa, at, at + LENGTH), b.of(sb, at, at + LENGTH), rids[t], at - offsets[t] + bases[t], one, one)
                continue
            q = (cut - at) // block
            head = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (cut[1:] != cut[:-1]) | (at[1:] != at[:-1] + 1)))
            low, high, cut, q, t = at[head], at[np.append(head[1:], len(at)) - 1], cut[head], q[head], t[head]
            k1 = _mix(a.of(sa, cut - block * q, cut - block * q - block + 1 + LENGTH) + q.astype(np.uint64))
            k2 = _mix(b.of(sb, low, high + LENGTH) + ((high - low) * 512 + cut - low).astype(np.uint64))
            yield merged(k1, k2, rids[t], low - offsets[t] + bases[t], high - low + 1, cut - low)

    return run


def _scan(batches):
    """Status of the entries of a partition sorted by (k1, k2): rid, pos, status.  Column `split`: k1 is dealt
    out over several partitions and is known to have several k2.

    Only the last name of a batch can go on in the next; of it one row is held.
    """
    held = None  # (k1, k2, rid, pos, split, weight, emitted), others at k1
    for b in _chain(batches):
        if b is None:  # the end
            if held is not None:
                yield from _status(*[np.array([x]) for x in held[0]], held[1], True)[0]
            return
        k1, k2, rid, pos, split = (np.asarray(b.column(k)) if k < 4 else b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        now, others = (k1, k2, rid, pos, split, pos & 3, np.zeros(len(k1), dtype=bool)), False
        if held is not None:
            now, others = tuple(np.append(np.array([h], dtype=x.dtype), x) for h, x in zip(held[0], now)), held[1]
        out, held = _status(*now, others, False)
        yield from out


def _chain(batches):
    for b in batches:
        if b.num_rows:
            yield b
    yield None


def _status(k1, k2, rid, pos, split, weight, emitted, others, last):
    new1 = np.append(True, k1[1:] != k1[:-1])
    new = new1 | np.append(True, k2[1:] != k2[:-1])
    group, begin = np.cumsum(new) - 1, np.flatnonzero(new)
    total = np.add.reduceat(weight, begin)
    run = (np.cumsum(new1) - 1)[begin]
    more = np.bincount(run) > 1
    more[0] |= others
    more, twice = more[run] | split[begin], total > 1
    held = None
    if not last:
        k = begin[-1]
        held = (k1[k], k2[k], rid[k], pos[k], split[k], min(int(total[-1]), 2), bool(emitted[k] or twice[-1])), bool(more[-1])
    done = np.ones(len(begin), dtype=bool)
    done[-1] = last
    rows = []
    full = twice[group] & ~emitted
    rows.append((rid[full], pos[full], FULL))
    part = begin[~twice & more & done]
    rows.append((rid[part], pos[part], PARTIAL))
    some = begin[twice & more & done]
    rows.append((rid[some], pos[some], SAMPLE))
    out = [pa.RecordBatch.from_arrays([pa.array(r), pa.array(p), pa.array(np.full(len(r), s, dtype=np.int32))], names=["rid", "pos", "status"]) for r, p, s in rows if len(r)]
    return out, held


def write_texts(rows: DataFrame, folder: str) -> DataFrame:
    """Texts in files of compressed batches; the manifest (part, path, n).  A text's rid is part << 33
    and its number in the file.  Files of lost tasks stand in no manifest."""
    schema = pa.schema([("doc_id", pa.int64()), ("z", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        fs, at = shared.open_fs(folder)
        part, name, out, n = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.arrow", None, 0
        for b in batches:
            for c in range(0, b.num_rows, 256):
                some = b.slice(c, 256)
                z = [zlib.compress((t.as_py() or "").encode("utf-8", "surrogatepass"), 1) for t in some.column(1)]
                out = out or pa.ipc.new_stream(fs.open_output_stream(f"{at}/{name}"), schema)
                out.write_batch(pa.RecordBatch.from_arrays([some.column(0), pa.array(z, pa.binary())], schema=schema))
                n += len(z)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/{name}"], "n": [n]})

    return shared.stored(rows.mapInArrow(run, "part long, path string, n long"), "manifest", f"{folder}/_manifest")


def with_texts(manifest: DataFrame, places: DataFrame | None, function, schema: str) -> DataFrame:
    """function(rows (rid, doc_id, z, places of the text or None)) over every file; places: rid, pos."""
    rows = manifest.select("part", F.lit(-1).cast("long").alias("rid"), F.lit(0).cast("long").alias("pos"), "path")
    files = max(1, manifest.count())
    if places is not None:
        rows = rows.unionByName(places.select(F.shiftright("rid", 33).alias("part"), "rid", "pos", F.lit(None).cast("string").alias("path")))

    def groups(batches):
        """(rid, path) of a file, then (rid, places) of its texts that have any."""
        rid_held, held = None, []
        for b in batches:
            rid, pos = np.asarray(b.column(1)), np.asarray(b.column(2))
            edge = np.flatnonzero(np.append(True, rid[1:] != rid[:-1])) if len(rid) else []
            for k, s in enumerate(edge):
                e = edge[k + 1] if k + 1 < len(edge) else len(rid)
                if rid[s] == -1:
                    if held:
                        yield rid_held, np.concatenate(held)
                    rid_held, held = None, []
                    for i in range(s, e):
                        yield -1, (int(b.column(0)[i].as_py()), b.column(3)[i].as_py())
                elif rid[s] == rid_held:
                    held.append(pos[s:e])
                else:
                    if held:
                        yield rid_held, np.concatenate(held)
                    rid_held, held = int(rid[s]), [pos[s:e]]
        if held:
            yield rid_held, np.concatenate(held)

    def texts(batches):
        found = groups(batches)
        now = next(found, None)
        while now is not None:
            part, path = now[1]
            now = next(found, None)
            fs, at = shared.open_fs(path)
            with fs.open_input_stream(at) as src, pa.ipc.open_stream(src) as stream:
                rid = part << 33
                for b in stream:
                    for doc_id, z in zip(b.column(0), b.column(1)):
                        mine = None
                        if now is not None and now[0] == rid:
                            mine, now = now[1], next(found, None)
                        yield rid, doc_id.as_py(), z.as_py(), mine
                        rid += 1

    return rows.repartition(files, "part").sortWithinPartitions("part", "rid").mapInArrow(lambda batches: function(texts(batches)), schema)


def _finish(keep_text: bool):
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text

    def run(texts):
        rows, size = [], 0
        for _, doc_id, z, pos in texts:
            text = zlib.decompress(z)
            kept, removed, runs = text, 0, 0
            if pos is not None:
                first, count, _ = unpacked(pos)
                begin, end = first, first + count - 1 + LENGTH
                order = np.argsort(begin, kind="stable")
                begin, reach = begin[order], np.maximum.accumulate(end[order])
                new = np.flatnonzero(np.append(True, begin[1:] > reach[:-1]))
                begin, end = begin[new], reach[np.append(new[1:], len(reach)) - 1]
                removed, runs = int((end - begin).sum()), len(begin)
                kept = b"".join([text[a:z] for a, z in zip([0, *end.tolist()], [*begin.tolist(), len(text)])])
            rows.append((doc_id, len(text), removed, runs, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            size += len(kept)
            if len(rows) >= 10_000 or keep_text and size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def remove_repeats(docs: DataFrame, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row; with keep_text also the bytes left."""
    rows = docs.select(shared.quoted(id_col).cast("long").alias("doc_id"), shared.quoted(text_col).cast("string").alias("text"))
    texts = write_texts(rows, shared.scratch(docs.sparkSession, "texts"))
    full, places = None, None
    for look in (_entries, _closer(BLOCK), _closer(1)):
        entries = with_texts(texts, places, look, ENTRY)
        # Keys of many entries with several k2: fewer than entries / HOT, so their table is small.  They are dealt out by k2.
        some = with_texts(texts, places, _some_keys(look), KEYS).groupBy("k1").agg(F.sum("n").alias("n"), F.min("x").alias("x"), F.max("y").alias("y"))
        hot = shared.stored(some.filter((F.col("n") * SHARE > HOT) & (F.col("x") < F.col("y"))).select("k1", F.lit(True).alias("split")), "hot")
        entries = entries.join(F.broadcast(hot), "k1", "left").withColumn("split", F.coalesce("split", F.lit(False)))
        dealt = entries.repartition("k1", F.when(F.col("split"), F.pmod("k2", F.lit(1 << 16))).otherwise(0)).sortWithinPartitions("k1", "k2")
        flags = shared.stored(dealt.mapInArrow(_scan, "rid long, pos long, status int"), "flags")
        known = flags.filter(F.col("status") == FULL).select("rid", "pos")
        full = known if full is None else full.unionByName(known)
        places = flags.filter(F.col("status") != FULL).select("rid", "pos")
    return with_texts(texts, full, _finish(keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def op4_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(shared.table(spark, sf_dir, "documents"))
