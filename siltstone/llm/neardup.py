"""Near-duplicate records with small edits: signature-coordinate inverted join with prefix and skip merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX2, MIX3, discard, mix, ship, small, written
from .components import connected_components
from .overlap import join_postings, postings
from .shingles import distinct_sorted, half_bytes, minhash, shingle_hashes, word_hashes

#: Signature coordinates.  Of each the low half-byte goes along with every posting; the first POSTED ones are posted in full.
COORDINATES, POSTED = 48, 20
#: Posted coordinates that a pair must share: a pair at similarity 0.6 shares 12 of 20 on average, and under 5 with
#: probability 0.0003; at 0.65 with 0.00005, at 0.7 with 0.000006.
MATCHES = 5
#: Half-bytes of the whole signature that must agree before a pair is checked: under 18 of 48 agree with probability
#: 0.0001 at similarity 0.6 and 0.000004 at 0.65, but 18 or more with 0.03 at 0.2.
SIG_MATCHES = 18
#: Bands of successive coordinates in which large groups of near-copies are looked for, and the least size of such a group.
BANDS, HOT = 8, 512
#: Documents of a block when all pairs inside a group are compared.
SIDE = 2048


def set_columns(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    h, at = word_hashes(texts)
    return distinct_sorted(*shingle_hashes(h, at, k))


def signatures(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(id, ck binary, elems array<bigint>, bands array<bigint>, sig binary): digest of the shingle set, its posted coordinates
    with their values, hashes of its bands, and the half-bytes of all coordinates; texts under k words give no row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s, off = set_columns(b.column(1).to_pylist(), k)
            full = np.flatnonzero(np.diff(off) > 0)
            if not len(full):
                continue
            off = np.append(off[full], off[-1])
            mh = minhash(s, off, COORDINATES)
            e = mix((mh[:, :POSTED].astype(np.uint64) * MIX2) ^ (np.arange(1, POSTED + 1, dtype=np.uint64) * MIX3)).view(np.int64)
            band = np.zeros((len(full), BANDS), dtype=np.uint64)
            for c in range(COORDINATES):
                j = c * BANDS // COORDINATES
                band[:, j] = mix((band[:, j] ^ mh[:, c]) + np.uint64(j))
            lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(full)), pa.array(_digests(s, off), pa.binary()), lists(e), lists(band), pa.array([x.tobytes() for x in half_bytes(mh)], pa.binary())],
                names=["id", "ck", "elems", "bands", "sig"],
            )

    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null").mapInArrow(sign, "id bigint, ck binary, elems array<bigint>, bands array<bigint>, sig binary")


def _digests(s: np.ndarray, off: np.ndarray) -> list[bytes]:
    raw = memoryview(np.ascontiguousarray(s)).cast("B")
    o = (off * 8).tolist()
    return [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(o, o[1:])]


def shingle_sets(docs: DataFrame, key: str, text: str, ids: DataFrame, k: int) -> DataFrame:
    """(id, sh array<int>) of the documents that ids lists: the upper halves of the shingle hashes, sorted."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s, off = set_columns(b.column(1).to_pylist(), k)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array((s >> np.uint64(32)).astype(np.uint32).view(np.int32)))], names=["id", "sh"])

    wanted = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).join(small(ids, 100_000), "id", "left_semi")
    return wanted.mapInArrow(sets, "id bigint, sh array<int>")


def similar_pairs(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) those whose sets have at least that similarity (exact), with it."""
    x = pairs.join(sets.select(F.col("id").alias("a"), F.col("sh").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("sh").alias("sb")), "b").select("a", "b", "sa", "sb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            if not r.num_rows:
                continue
            sim = np.empty(r.num_rows)
            ca, cb = r.column(2), r.column(3)
            va, vb = ca.values.to_numpy(), cb.values.to_numpy()
            oa, ob = ca.offsets.to_numpy(), cb.offsets.to_numpy()
            for i in range(r.num_rows):
                p, q = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
                both = np.concatenate([p, q])
                both.sort()
                common = np.count_nonzero(both[1:] == both[:-1])
                sim[i] = common / (len(both) - common)
            ok = pa.array(sim >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([r.column(0), r.column(1), pa.array(sim)], names=["a", "b", "similarity"]).filter(ok)

    return x.mapInArrow(check, "a bigint, b bigint, similarity double")


def hot_links(docs: DataFrame, key: str, text: str, classes: DataFrame, k: int, threshold: float) -> DataFrame | None:
    """Checked links from members of large groups of near-copies to the least document with the same band; None if there is no such group.

    A band's size and its least document are partial aggregates.  Only bands of more than HOT documents count, and each of
    their documents is compared with one leader, so the work is linear in the group.
    """
    band = classes.select("id", F.explode("bands").alias("band"))
    hot = written(band.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a")).where(F.col("n") > HOT).select("band", "a"), "hot")
    if not hot.take(1):
        return None
    pairs = written(band.join(small(hot, 100_000), "band").groupBy(F.col("id").alias("b")).agg(F.min("a").alias("a")).where("a < b").select("a", "b"), "leaders")
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    sets = written(shingle_sets(docs, key, text, ids, k), "sets")
    links = written(similar_pairs(pairs, sets, threshold).select("a", "b"), "hot_links")
    discard(hot, pairs, ids, sets)
    return links


def _close(v: np.ndarray, off: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of left and right (i < j, if both are the same rows) at the threshold; exact, by counting common elements in matrices."""
    n = np.diff(off)
    doc = np.repeat(np.arange(len(n)), n)
    same = left is right
    cut = lambda rows: [rows[i : i + 512] for i in range(0, len(rows), 512)]
    for x, one in enumerate(cut(left)):
        for two in cut(right)[x * same :]:
            part = [np.isin(doc, r) for r in (one, two)]
            every = np.intersect1d(v[part[0]], v[part[1]])
            common = np.zeros((len(one), len(two)), np.float32)
            for lo in range(0, len(every), 8192):
                u = every[lo : lo + 8192]
                m = []
                for r, p in zip((one, two), part):
                    at = np.minimum(np.searchsorted(u, v[p]), len(u) - 1)
                    hit = u[at] == v[p]
                    m.append(np.zeros((len(r), len(u)), np.float32))
                    m[-1][np.searchsorted(r, doc[p][hit]), at[hit]] = 1
                common += m[0] @ m[1].T
            i, j = np.nonzero(common / (n[one][:, None] + n[two] - common.astype(np.float64)) >= threshold - 1e-12)
            i, j = one[i], two[j]
            ok = i < j if same else slice(None)
            yield i[ok], j[ok]


def inside(docs: DataFrame, key: str, text: str, groups: DataFrame, k: int, threshold: float, count: bool) -> DataFrame:
    """All pairs (a, b) inside the groups (id, component) at the threshold, or with count the number of them (id, links).

    A group's documents are dealt to blocks, each pair of blocks is a task, and counts leave it without the pairs.
    """
    size = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("g"))
    placed = groups.join(small(size, 100_000), "component").select("component", "id", F.pmod(F.xxhash64("id"), "g").cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("y"))
    rows = placed.join(shingle_sets(docs, key, text, groups.select("id"), k), "id").select("component", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), (F.col("x") > F.col("y")).alias("second"), "id", "sh")

    def compare(table: pa.Table) -> pa.Table:
        t = table.combine_chunks().to_batches()[0]
        ids, second, sh = np.asarray(t.column("id")), np.array(t.column("second").to_pylist(), bool), t.column("sh")
        off = sh.offsets.to_numpy().astype(np.int64)
        v, off = sh.values.to_numpy()[off[0] : off[-1]], off - off[0]
        one, two = np.flatnonzero(~second), np.flatnonzero(second)
        apart = table.column("lo")[0] != table.column("hi")[0]
        links, found = np.zeros(len(ids), np.int64), [(ids[:0], ids[:0])]
        for i, j in _close(v, off, one, two if apart else one, threshold):
            if count:
                links += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
            else:
                found.append((np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])))
        if count:
            return pa.table({"id": ids, "links": links})
        return pa.table({c: np.concatenate([x[i] for x in found]) for i, c in enumerate("ab")})

    out = rows.groupBy("component", "lo", "hi").applyInArrow(compare, "id bigint, links bigint" if count else "a bigint, b bigint")
    return out.groupBy("id").agg(F.sum("links").alias("links")) if count else out


def _linked(docs: DataFrame, key: str, text: str, k: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """(membership, links, hot, groups): links between documents of different large groups or outside them; and if there are large
    groups, the links to leaders that connect them, and their documents (id, component), else None."""
    ship(docs.sparkSession)
    sig = written(signatures(docs, key, text, k), "signatures")
    reps = sig.groupBy("ck").agg(F.min("id").alias("rep"))
    member = written(sig.select("id", "ck").join(reps, "ck").select("id", "rep"), "members")
    classes = sig.join(member.where("id = rep").select("id"), "id", "left_semi")
    hot = hot_links(docs, key, text, classes, k, threshold)
    groups = None
    if hot is None:
        sets = classes.withColumn("grp", F.col("id"))
    else:
        groups = written(connected_components(hot, "a", "b").select(F.col("node").alias("id"), "component"), "groups")
        sets = classes.join(groups, "id", "left").withColumn("grp", F.coalesce("component", "id"))
    sets = sets.select("id", "grp", "elems", F.lit(MATCHES).alias("need"), "sig")
    sets = sets if hot is None else written(sets, "grouped")
    pairs = join_postings(postings(sets, by_group=True), COORDINATES // 2, SIG_MATCHES)
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    links = written(similar_pairs(pairs, shingle_sets(docs, key, text, ids, k), threshold).select("a", "b"), "links")
    discard(sig, pairs, ids)
    return member, links, hot, groups


def near_duplicates(docs: DataFrame, key: str = "source_ord", text: str = "text", k: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(membership, links): id -> rep, the least id with the same shingle set; and rep pairs at or above the threshold.

    Copies are contracted to their least id before any pairing (partial minima, then one row a class), so a class that
    holds a third of all rows is one document in the join.  A large group of near-copies is first linked to leaders; the
    join then makes no pairs inside what these links connect, and those pairs are compared block by block.  Null texts, and
    texts under k words, are in neither result.
    """
    member, links, _, groups = _linked(docs, key, text, k, threshold)
    return member, links if groups is None else links.union(inside(docs, key, text, groups, k, threshold, False))


def near_duplicate_groups(docs: DataFrame, key: str = "source_ord", text: str = "text", k: int = 5, threshold: float = 0.8, count: bool = True) -> DataFrame:
    """(id, rep, links, first): one row per document with at least k words; first is the least id of its group, links the
    number of its class's links, which only count asks for (inside large groups every pair is compared for it)."""
    member, links, hot, groups = _linked(docs, key, text, k, threshold)
    info = connected_components(links if hot is None else links.union(hot), "a", "b").withColumnRenamed("node", "rep")
    if count:
        ends = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
        if groups is not None:
            ends = ends.union(inside(docs, key, text, groups, k, threshold, True).withColumnRenamed("id", "rep"))
        info = written(info.join(ends.groupBy("rep").agg(F.sum("links").alias("links")), "rep"), "info")
    every = member.join(small(info, 50_000), "rep", "left")
    return every.select("id", "rep", *[F.coalesce("links", F.lit(0)).alias("links")] * count, F.coalesce("component", "rep").alias("first"))
