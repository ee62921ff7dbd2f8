"""Same or near-same records across splits: posted prefixes of shingle sets, collinear chains, extension, coverage."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, ship, small, written
from .neardup import COORDINATES, _digests
from .overlap import join_postings
from .shingles import distinct_sorted, half_bytes, minhash, shingle_hashes, winnow, word_hashes

#: For coverage: windows of WINDOW successive shingles; texts of at most SHORT shingles keep all.
WINDOW, SHORT = 12, 24
#: Bits of the hash by which a side's shingles are noted, and by which they are counted; slices in which tasks send both.
SEEN_BITS, COUNT_BITS, SLICES = 26, 20, 64
#: Half-bytes of the signature that must agree before a pair is checked: under 14 of 48 agree with probability 0.000001 at similarity 0.6.
SEED_MATCHES = 14
#: A chain may jump over so many words, and drift by so many between the two texts.
GAP, DRIFT = 60, 30


def sketch(docs: DataFrame, text: str, side, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(seen, counts): by shingle hash, which sides may hold it (bit 0 train, bit 1 evaluation) and about how often it occurs.

    A shingle that both sides hold always has both bits.  Tasks send compressed slices, so at most a few bytes a shingle are shuffled.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counts = [np.zeros(1 << SEEN_BITS, bool) for _ in range(2)], np.zeros(1 << COUNT_BITS, np.uint32)
        for b in batches:
            h, at = word_hashes(b.column(1).to_pylist())
            flow, off = shingle_hashes(h, at, k)
            both = np.repeat(np.asarray(b.column(0)), np.diff(off))
            for j in range(2):
                seen[j][flow[both == j + 1] >> np.uint64(64 - SEEN_BITS)] = True
            counts += np.bincount(flow >> np.uint64(64 - COUNT_BITS), minlength=1 << COUNT_BITS).astype(np.uint32)
        if not counts.any():
            return
        for j, whole in enumerate((*map(np.packbits, seen), counts)):
            for i, x in enumerate(np.split(whole, SLICES)):
                yield pa.RecordBatch.from_pydict({"kind": pa.array([j], pa.int32()), "slice": pa.array([i], pa.int32()), "part": pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())})

    def merge(t: pa.Table) -> pa.Table:
        kind = t.column("kind")[0].as_py()
        parts = (np.frombuffer(zlib.decompress(x.as_py()), np.uint32 if kind == 2 else np.uint8) for x in t.column("part"))
        whole = next(parts).copy()
        for x in parts:
            whole = whole + x if kind == 2 else whole | x
        return pa.table({"kind": t.column("kind").slice(0, 1), "slice": t.column("slice").slice(0, 1), "part": pa.array([whole.tobytes()], pa.binary())})

    form = "kind int, slice int, part binary"
    t = docs.select(side.cast("tinyint").alias("side"), F.col(text).alias("text")).where("side is not null and text is not null").mapInArrow(part, form).groupBy("kind", "slice").applyInArrow(merge, form).toArrow()
    got = {(j, i): x for j, i, x in zip(*(c.to_pylist() for c in t.columns))}
    if not got:
        return np.zeros(1 << SEEN_BITS, np.uint8), np.zeros(1 << COUNT_BITS, np.uint32)
    whole = [b"".join(got[j, i] for i in range(SLICES)) for j in range(3)]
    both = np.frombuffer(whole[0], np.uint8) & np.frombuffer(whole[1], np.uint8)
    return both, np.frombuffer(whole[2], np.uint32)


def prefixes(s: np.ndarray, off: np.ndarray, threshold: float, both: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set the elements that it is posted under, and offsets.

    Two sets of n and m elements at the threshold share at least threshold * n and threshold * m of them, so in one order
    of all elements the first shared one stands among the first n - ceil(threshold * n) + 1 of either.  Elements that one
    side alone holds come first in that order and are not posted, then rare ones.
    """
    n = np.diff(off)
    at = s >> np.uint64(64 - SEEN_BITS)
    two = (both[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1
    rank = np.where(two > 0, counts[s >> np.uint64(64 - COUNT_BITS)].astype(np.int64) + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((s, rank, doc))
    first = n - np.maximum(1, np.ceil(threshold * n - 1e-9)).astype(np.int64) + 1
    keep = (np.arange(len(s)) - np.repeat(off[:-1], n) < np.repeat(first, n)) & (rank[order] > 0)
    return s[order][keep], np.concatenate([[0], np.cumsum(keep)])[off]


def fingerprints(docs: DataFrame, key: str, text: str, side, k: int, threshold: float) -> DataFrame:
    """(id, side, ck, elems, sig) of each document with at least k words; side is 1 for train, 2 for evaluation; elems are
    the shingles under which it is posted."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch(docs, text, side, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, counts = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            h, at = word_hashes(b.column(2).to_pylist())
            flow, off = shingle_hashes(h, at, k)
            full = np.flatnonzero(np.diff(off) > 0)
            if not len(full):
                continue
            off = np.append(off[full], off[-1])
            s, s_off = distinct_sorted(flow, off)
            elems, e_off = prefixes(s, s_off, threshold, both, counts)
            sig = half_bytes(minhash(s, s_off, COORDINATES))
            rows = pa.array(full)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(rows), b.column(1).take(rows), pa.array(_digests(s, s_off), pa.binary()),
                    pa.ListArray.from_arrays(pa.array(e_off.astype(np.int32)), pa.array(elems.view(np.int64))), pa.array([x.tobytes() for x in sig], pa.binary()),
                ],
                names=["id", "side", "ck", "elems", "sig"],
            )

    return docs.select(F.col(key).cast("bigint").alias("id"), side.cast("tinyint").alias("side"), F.col(text).alias("text")).where("id is not null and side is not null and text is not null").mapInArrow(
        run, "id bigint, side tinyint, ck binary, elems array<bigint>, sig binary"
    )


def chain(seeds: list[tuple[int, int]], places: dict[int, list[int]]) -> list[tuple[int, int, int, int]]:
    """Collinear chains of common seeds: (first a, last a, first b, last b).

    seeds are the (place in a, value) of the common seeds in order, places the sorted places of each value in b.  A chain
    goes on with a seed at most GAP words on in both texts and at most DRIFT words off its diagonal.  As long as a value stands at several
    places of b, a chain keeps all of them that fit, so a repeated line doesn't lead it astray; the least drift decides at its end.
    """
    out: list[tuple[int, int, dict[int, int]]] = []
    live: list[list] = []  # first a, last a, {last b: first b}
    for x, v in seeds:
        there = places[v]
        for c in [c for c in live if x - c[1] > GAP]:
            out.append(tuple(c))
        live = [c for c in live if x - c[1] <= GAP]
        for c in reversed(live):
            dx = x - c[1]
            on: dict[int, int] = {}
            ends = list(c[2])  # rises with every step
            for y in there[bisect.bisect_right(there, ends[0]) : bisect.bisect_right(there, ends[-1] + GAP)]:
                i = bisect.bisect_left(ends, y - dx)  # the nearest ends to both sides of y's diagonal
                near = [e for e in ends[max(i - 1, 0) : i + 1] if 0 < y - e <= GAP and abs(y - e - dx) <= DRIFT]
                if near:
                    on[y] = c[2][min(near, key=lambda e: abs(y - e - dx))]
            if dx > 0 and on:
                c[1], c[2] = x, on
                break
        else:
            live.append([x, x, {y: y for y in there}])
    done = []
    for a0, a1, ends in [*out, *map(tuple, live)]:
        b1 = min(ends, key=lambda y: (abs(y - ends[y] - a1 + a0), y))
        done.append((a0, a1, ends[b1], b1))
    return done


def covered(a: np.ndarray, b: np.ndarray, k: int, window: int, short: int) -> float:
    """Share of the words of a that chains of common seeds, extended by alignment, cover."""
    va, xa, _ = winnow(*shingle_hashes(a, np.array([0, len(a)]), k), window, short)
    vb, xb, _ = winnow(*shingle_hashes(b, np.array([0, len(b)]), k), window, short)
    places: dict[int, list[int]] = {}
    for v, p in zip(vb.tolist(), xb.tolist()):
        places.setdefault(v, []).append(p)
    seeds, last = [], None
    for p, v in sorted(zip(xa.tolist(), va.tolist())):
        if v in places and last != (p - 1, v):  # inside a run of one value, alignment goes on by itself
            seeds.append((p, v))
        last = p, v
    mark = np.zeros(len(a), dtype=bool)
    for a0, a1, b0, b1 in chain(seeds, places):
        while a0 > 0 and b0 > 0 and a[a0 - 1] == b[b0 - 1]:
            a0, b0 = a0 - 1, b0 - 1
        e, f = a1 + k, b1 + k
        while e < len(a) and f < len(b) and a[e] == b[f]:
            e, f = e + 1, f + 1
        mark[a0:e] |= np.isin(a[a0:e], b[b0:f])
    return float(mark.mean()) if len(a) else 0.0


def aligned(pairs: DataFrame, words: DataFrame, k: int, threshold: float, window: int = WINDOW, short: int = SHORT) -> DataFrame:
    """(a, b, similarity, coverage_a, coverage_b) of the pairs whose exact shingle similarity reaches the threshold."""
    x = pairs.join(words.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a").join(words.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b").select("a", "b", "wa", "wb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            if not r.num_rows:
                continue
            sim, ca, cb = np.zeros(r.num_rows), np.zeros(r.num_rows), np.zeros(r.num_rows)
            cols = [(c.values.to_numpy().view(np.uint32).astype(np.uint64), c.offsets.to_numpy()) for c in (r.column(2), r.column(3))]
            sets = []
            for v, o in cols:
                s, so = shingle_hashes(v[o[0] : o[-1]], (o - o[0]).astype(np.int64), k)
                sets.append(distinct_sorted(s, so))
            for i in range(r.num_rows):
                (p, po), (q, qo) = sets
                both = np.concatenate([p[po[i] : po[i + 1]], q[qo[i] : qo[i + 1]]])
                both.sort()
                common = np.count_nonzero(both[1:] == both[:-1])
                sim[i] = common / max(1, len(both) - common)
                if sim[i] >= threshold - 1e-12:
                    u, v = (c[o[i] : o[i + 1]] for c, o in cols)
                    ca[i], cb[i] = covered(u, v, k, window, short), covered(v, u, k, window, short)
            keep = pa.array(sim >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([r.column(0), r.column(1), pa.array(sim), pa.array(ca), pa.array(cb)], names=["a", "b", "similarity", "coverage_a", "coverage_b"]).filter(keep)

    return x.mapInArrow(run, "a bigint, b bigint, similarity double, coverage_a double, coverage_b double")


def hashed_words(docs: DataFrame, key: str, text: str, ids: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                h, at = word_hashes(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array((h >> np.uint64(32)).astype(np.uint32).view(np.int32)))], names=["id", "w"])

    wanted = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).join(small(ids, 100_000), "id", "left_semi")
    return wanted.mapInArrow(run, "id bigint, w array<int>")


def cross_split_pairs(docs: DataFrame, key: str = "record_no", text: str = "text", split: str = "split", train: str = "train", evaluation: tuple[str, ...] = ("validation", "test"), k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(a, b, similarity, coverage_a, coverage_b): each train record a with each evaluation record b it overlaps.

    Equal shingle sets are one class with the splits it occurs in; only class representatives are fingerprinted, joined,
    chained and aligned, and the pairs of classes are then written out as pairs of records.  Null texts, texts under k
    words and other splits take no part; repeated rows give repeated pairs.
    """
    ship(docs.sparkSession)
    side = F.when(F.col(split) == train, 1).when(F.col(split).isin(*evaluation), 2)
    prints = written(fingerprints(docs, key, text, side, k, threshold), "fingerprints")
    reps = prints.groupBy("ck").agg(F.min("id").alias("rep"), F.expr("cast(bit_or(side) as tinyint)").alias("sides"))
    member = written(prints.select("id", "side", "ck").join(reps, "ck").select("id", "side", "rep", "sides"), "members")
    sets = prints.drop("side").join(member.where("id = rep").select("id", F.when(F.col("sides") == 3, F.col("id")).otherwise(-F.col("sides").cast("bigint")).alias("grp")), "id")
    pairs = join_postings(sets.select(F.explode("elems").alias("key"), "id", "grp", "sig"), COORDINATES // 2, SEED_MATCHES)
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    found = written(aligned(pairs, hashed_words(docs, key, text, ids), k, threshold), "aligned")
    discard(prints, pairs, ids)
    flip = found.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity", F.col("coverage_b").alias("coverage_a"), F.col("coverage_a").alias("coverage_b"))
    same = member.where("id = rep and sides = 3").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"), F.lit(1.0).alias("coverage_a"), F.lit(1.0).alias("coverage_b"))
    every = found.union(flip).union(same)
    left = member.where("side = 1").select(F.col("rep").alias("ra"), F.col("id").alias("ia"))
    right = member.where("side = 2").select(F.col("rep").alias("rb"), F.col("id").alias("ib"))
    out = every.join(left, F.col("a") == F.col("ra")).join(right, F.col("b") == F.col("rb"))
    return out.select(F.col("ia").alias("a"), F.col("ib").alias("b"), "similarity", "coverage_a", "coverage_b")

