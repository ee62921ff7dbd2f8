"""Inverted join of element sets with prefix and skip merging.

Documents carry a set of 64-bit elements (signature coordinate-value pairs, or fingerprints), the number of elements
they must share with a partner, and a group; only documents of different groups are paired.  Each posts itself under its rarest elements only: with n elements of which t must be
shared, the t - 1 most frequent ones are skipped, and no pair is lost.  An element that is still frequent is not posted
by itself but with each later frequent element of the prefix, since a pair whose rarest shared element is frequent and that shares
two elements shares another frequent one; so the number to share must be one that a pair really reaches.  Overlap across splits
posts frequent elements singly (crosssplit.prefixes).
Lists that stay long are cut into blocks, those of a large group apart, and each pair of blocks that may hold a pair is
a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX2, discard, mix, written

#: An element in at most this many documents is never called frequent.
LIGHT = 256
#: Bound of the frequent list that is sent to all executors: at most so many elements are in 1 / MOST_FREQUENT of the postings.
MOST_FREQUENT = 400_000
#: Lists above this length are cut into blocks of this length.
BLOCK = 2048

#: How many of its two half-bytes are zero, for each byte.
_SAME = np.array([(x < 16) + (x % 16 == 0) for x in range(256)], dtype=np.uint8)

POSTING = "key bigint, id bigint, grp bigint, sig binary"


def frequent(sets: DataFrame, light: int = LIGHT, by_group: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Frequent elements (sorted) and their counts: of documents, or with by_group of groups.

    The limit is max(light, postings / MOST_FREQUENT), so the list has at most MOST_FREQUENT entries (6 MB) at any size.
    """
    total = sets.agg(F.sum(F.size("elems"))).first()[0] or 0
    limit = max(light, total // MOST_FREQUENT)
    if by_group:
        lone = sets.where("grp = id").select(F.explode("elems").alias("key"))
        shared = sets.where("grp <> id").select("grp", F.explode("elems").alias("key")).distinct().select("key")
        post = lone.union(shared)
    else:
        post = sets.select(F.explode("elems").alias("key"))
    t = post.groupBy("key").count().where(F.col("count") > limit).toArrow()
    k, c = t.column(0).to_numpy().astype(np.int64), t.column(1).to_numpy()
    o = np.argsort(k)
    return k[o], c[o]


def _two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((a.view(np.uint64) * MIX2) ^ b.view(np.uint64)).view(np.int64)


def plan_keys(flat: np.ndarray, off: np.ndarray, need: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posting keys of each document and the document's number in the batch."""
    n = np.diff(off)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
    freq = np.where(keys[at] == flat, counts[at], 0) if len(keys) else np.zeros(len(flat), np.int64)
    order = np.lexsort((flat, freq, doc))
    flat, freq, doc = flat[order], freq[order], doc[order]
    place = np.arange(len(flat)) - np.repeat(off[:-1], n)
    first = np.repeat(n - need + 1, n)  # so many elements hold the rarest shared one
    in_first, heavy, alone = place < first, freq > 0, np.repeat(need < 2, n)
    single = in_first & (~heavy | alone)
    out_k, out_d = [flat[single]], [doc[single]]
    both = heavy & (place < first + 1) & ~alone | heavy & alone
    hd, hk = doc[both], flat[both]
    if len(hd):
        u, begin, count = np.unique(hd, return_index=True, return_counts=True)
        for c in np.unique(count[count > 1]):
            rows = begin[count == c][:, None] + np.arange(c)
            i, j = np.triu_indices(c, 1)
            out_k.append(_two(hk[rows[:, i]].ravel(), hk[rows[:, j]].ravel()))
            out_d.append(np.repeat(u[count == c], len(i)))
    return np.concatenate(out_k), np.concatenate(out_d)


def postings(sets: DataFrame, light: int = LIGHT, by_group: bool = False) -> DataFrame:
    """sets: id bigint, grp bigint, elems array<bigint> (distinct), need int, sig binary -> POSTING rows."""
    keys, counts = frequent(sets, light, by_group)
    sent = sets.sparkSession.sparkContext.broadcast((keys, counts))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, c = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            e = b.column("elems")
            off = e.offsets.to_numpy().astype(np.int64)
            flat = e.values.to_numpy()[off[0] : off[-1]] if len(e.values) else np.zeros(0, np.int64)
            key, doc = plan_keys(flat, off - off[0], np.asarray(b.column("need")), k, c)
            for lo in range(0, len(key), 100_000):
                d = pa.array(doc[lo : lo + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + 100_000]), b.column("id").take(d), b.column("grp").take(d), b.column("sig").take(d)], names=["key", "id", "grp", "sig"])

    return sets.select("id", "grp", "elems", "need", "sig").mapInArrow(post, POSTING)


def _matches(ids, grp, sigs, a, b, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the row pairs (a, b) those of different groups that agree in at least ``least`` signature half-bytes."""
    ok = grp[a] != grp[b]
    a, b = a[ok], b[ok]
    keep = _SAME[sigs[a] ^ sigs[b]].sum(axis=1, dtype=np.int16) >= least
    a, b = ids[a[keep]], ids[b[keep]]
    return np.minimum(a, b), np.maximum(a, b)


def _all_pairs(ids, grp, sigs, left, right, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matches of each row of left with each later row of right (or with each, if the two are different rows)."""
    found = []
    same = left is right
    for lo in range(0, len(left), 256):
        part, rest = left[lo : lo + 256], right[lo:] if same else right
        if grp[part].min() == grp[part].max() and (grp[rest] == grp[part[0]]).all():
            continue
        a, b = np.repeat(part, len(rest)), np.tile(rest, len(part))
        ok = (a < b) & (grp[a] != grp[b]) if same else grp[a] != grp[b]
        found.append(_matches(ids, grp, sigs, a[ok], b[ok], least))
    return found


def _sig_matrix(col: pa.Array, width: int) -> np.ndarray:
    raw = b"".join(col.to_pylist()) if col.null_count else np.frombuffer(col.buffers()[2], np.uint8)[np.frombuffer(col.buffers()[1], np.int32)[col.offset] :][: len(col) * width]
    return np.frombuffer(raw, np.uint8).reshape(len(col), width) if len(col) else np.zeros((0, width), np.uint8)


def _unique(found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    none = np.zeros(0, np.int64)
    return np.unique(np.stack([np.concatenate([none, *(x[i] for x in found)]) for i in (0, 1)], 1), axis=0)


def join_postings(post: DataFrame, width: int, least: int) -> DataFrame:
    """Candidate pairs (a < b), each once, of documents of different groups under the same key whose signatures agree in ``least`` half-bytes.

    Rows of one key come to one task in order.  A list of at most BLOCK rows is paired there; longer ones come out again
    as rows and are paired block by block in as many tasks as there are pairs of blocks.  The result is a written table.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(found, over) -> Iterator[pa.RecordBatch]:
            u = _unique(found)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1]), pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.binary())], names=["a", "b", "grp", "sig"])
            for key, ids, grp, sigs in over:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), key)), pa.array(ids), pa.array(grp), pa.array([x.tobytes() for x in sigs], pa.binary())], names=["a", "b", "grp", "sig"])

        held: list = []
        long_key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids, grp = (np.asarray(batch.column(i)) for i in range(3))
            sigs = _sig_matrix(batch.column(3), width)
            if held:
                key, ids, grp, sigs = (np.concatenate([h, x]) for h, x in zip(held, (key, ids, grp, sigs)))
            edge = np.flatnonzero(key[1:] != key[:-1]) + 1
            last = int(edge[-1]) if len(edge) else 0
            if len(key) - last > BLOCK or key[-1] == long_key:  # a long list is passed on as it comes
                held, cut, long_now = [], len(key), key[-1]
            else:
                held, cut, long_now = [x[last:] for x in (key, ids, grp, sigs)], last, None
            yield from done(*_lists(key[:cut], ids[:cut], grp[:cut], sigs[:cut], long_key, least))
            long_key = long_now if long_now is not None else long_key
        if held:
            yield from done(*_lists(*held, long_key, least))

    out = written(post.repartition("key").sortWithinPartitions("key").mapInArrow(pairs, "a bigint, b bigint, grp bigint, sig binary"), "pairs")
    found = out.where("sig is null").select("a", "b")
    rest = out.where("sig is not null").select(F.col("a").alias("key"), F.col("b").alias("id"), "grp", "sig")
    if not rest.take(1):
        made = written(found.distinct(), "candidates")
        discard(out)
        return made
    per = rest.groupBy("key", "grp").agg(F.count(F.lit(1)).alias("n"))
    big = per.where(F.col("n") > BLOCK).select("key", "grp", F.col("grp").alias("own"), F.ceil(F.col("n") / BLOCK).cast("int").alias("own_g"))
    common = per.where(F.col("n") <= BLOCK).groupBy("key").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("g"))
    blocks = big.select("key", "own", F.explode(F.sequence(F.lit(0), F.col("own_g") - 1)).alias("x")).union(common.select("key", F.lit(None).cast("bigint").alias("own"), F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("x")))
    blocks = written(blocks.select("key", F.struct("own", "x").alias("block"), "own"), "blocks")
    lo, hi = blocks.select("key", F.col("block").alias("lo"), F.col("own").alias("o1")), blocks.select("key", F.col("block").alias("hi"), F.col("own").alias("o2"))
    tasks = written(lo.join(hi, "key").where("lo <= hi and (o1 is null or o2 is null or o1 <> o2)").select("key", "lo", "hi"), "tasks")
    placed = rest.join(big, ["key", "grp"], "left").join(common, "key", "left")
    placed = placed.select("key", "id", "grp", "sig", F.struct("own", F.pmod(F.xxhash64("id"), F.coalesce("own_g", "g")).cast("int").alias("x")).alias("block"))
    left = placed.join(tasks, (placed["key"] == tasks["key"]) & (placed["block"] == tasks["lo"])).select(tasks["key"], "lo", "hi", "id", "grp", "sig", F.lit(0).alias("part"))
    right = placed.join(tasks, (placed["key"] == tasks["key"]) & (placed["block"] == tasks["hi"]) & (tasks["lo"] != tasks["hi"])).select(tasks["key"], "lo", "hi", "id", "grp", "sig", F.lit(1).alias("part"))

    def blocked(table: pa.Table) -> pa.Table:
        t = table.combine_chunks().to_batches()[0]
        ids, grp, part = (np.asarray(t.column(n)) for n in ("id", "grp", "part"))
        sigs = _sig_matrix(t.column("sig"), width)
        one, two = np.flatnonzero(part == 0), np.flatnonzero(part == 1)
        u = _unique(_all_pairs(ids, grp, sigs, one, two if len(two) else one, least))
        return pa.table({"a": u[:, 0], "b": u[:, 1]})

    more = left.union(right).groupBy("key", "lo", "hi").applyInArrow(blocked, "a bigint, b bigint")
    made = written(found.union(more).distinct(), "candidates")
    discard(out, blocks, tasks)
    return made


def _lists(key, ids, grp, sigs, long_key, least: int) -> tuple[list, list]:
    """Pairs of the short lists of sorted keys, and the long lists as they are."""
    found, over = [], []
    if not len(key):
        return found, over
    begin = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    count = np.diff(np.append(begin, len(key)))
    for c in np.unique(count[(count > 1) & (count <= 64)]):
        rows_all = begin[count == c]
        if long_key is not None:
            rows_all = rows_all[key[rows_all] != long_key]
        i, j = np.triu_indices(c, 1)
        step = max(1, 200_000 // len(i))
        for lo in range(0, len(rows_all), step):
            rows = rows_all[lo : lo + step, None] + np.arange(c)
            found.append(_matches(ids, grp, sigs, rows[:, i].ravel(), rows[:, j].ravel(), least))
    for s, c in zip(begin.tolist(), count.tolist()):
        if c > BLOCK or long_key is not None and key[s] == long_key:
            over.append((key[s], ids[s : s + c], grp[s : s + c], sigs[s : s + c]))
        elif c > 64:
            rows = np.arange(s, s + c)
            found += _all_pairs(ids, grp, sigs, rows, rows, least)
    return found, over
