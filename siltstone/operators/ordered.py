"""Ordered analytics that stay distributed: running sums, shard packing, ordinals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import written

#: Ranges of the ordinal over which a running sum is first added up.
RANGES = 1024
#: Shard packing works on ranges of rows that hold about so many shards, and at most so many ranges.
SHARDS, MOST_RANGES = 16, 4096


def ranged(df: DataFrame, order: str, parts: int, out: str = "_range") -> DataFrame:
    """df with the number of the range its ordinal lies in: ranges of about equally many rows, cut at quantiles."""
    cuts = np.array([])
    if parts > 1:
        cuts = np.unique(df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.25 / parts))

    @F.arrow_udf(T.IntegerType())
    def place(v: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, np.asarray(v), side="right").astype(np.int32))

    return df.withColumn(out, place(F.col(order).cast("bigint")) if len(cuts) else F.lit(0))


def running_before(df: DataFrame, value: Column, order: str, by: list[str] | None = None, out: str = "before") -> DataFrame:
    """df with the sum of value over all earlier rows (by order, within by), as a two-pass prefix sum.

    Rows are cut into at most RANGES ranges of about equal size.  Range sums are aggregated and prefixed (a few rows), sent to
    all tasks, and each range then only runs its own window, so no single task sees all rows.  Null ordinals are an error.
    """
    by = by or []
    d = ranged(df.withColumn("_v", F.coalesce(value.cast("bigint"), F.lit(0))), order, RANGES)
    sums = d.groupBy(*by, "_range").agg(F.sum("_v").alias("_s"))
    w = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("_base", F.coalesce(F.sum("_s").over(w), F.lit(0))).select(*by, "_range", "_base")
    inner = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = d.withColumn("_in", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
    return local.join(base, [*by, "_range"]).withColumn(out, F.col("_base") + F.col("_in")).drop("_range", "_v", "_in", "_base")


def budget_prefix(df: DataFrame, tokens: str, order: str, target: int) -> DataFrame:
    """Kept rows whose earlier kept rows have fewer tokens than the target: the row that crosses it stays in."""
    return running_before(df, F.col(tokens), order, out="tokens_before").where(F.col("tokens_before") < target)


def _next_starts(sums: np.ndarray, target: int, after: bool) -> np.ndarray:
    """For a shard that starts at row i of a range (sums: running sums with a 0 before), the row that starts the next one;
    n + 1 stands for none.  Row n is the first row of the range that follows."""
    n = len(sums) - 1
    if after:  # closes with the row that reaches the target
        return np.minimum(np.searchsorted(sums[1:], sums + target, side="left") + 1, n + 1)
    over = np.searchsorted(sums[1:], sums + target, side="right")  # the first row that overfills
    begun = np.searchsorted(sums[1:], sums, side="right") + 1  # an empty shard never closes
    nxt = np.maximum(np.maximum(over, begun), np.arange(1, n + 2))
    return np.where(nxt >= n, n + 1, nxt)


def _transfer(v: np.ndarray, target: int, after: bool) -> tuple[list[int], list[int], list[int]]:
    """What a range makes of the tokens that its first shard already has: (least, exit, shards), rising in least.

    With n tokens at the entry, the last row with least <= n tells how many shards end in the range and how many tokens the open one has at
    the exit; if there is none, no shard ends and n grows by the range's tokens.  Packings from different entries soon
    meet in a common start, so a range of several shards has few rows; for packing that closes before a row, n = 0 has a row of its own, with least -1.
    """
    sums = np.concatenate([[0], np.cumsum(v)])
    n = len(v)
    nxt = _next_starts(sums, target, after)
    jump, made = np.append(nxt, n + 1), np.append((nxt <= n).astype(np.int64), 0)
    ends = np.append(sums[-1] - sums, 0)
    stop = jump > n
    jump = np.where(stop, np.arange(n + 2), jump)
    while True:  # doubling: every start jumps to its last one
        further = jump[jump]
        if (further == jump).all():
            break
        made, jump = made + made[jump], further
    out = ends[jump]
    if after:  # the first shard ends with row j for n >= target - sums[j + 1], if no earlier row ends it
        start, least = np.arange(1, n + 1), target - sums[1:]
    else:
        start, least = np.arange(n), target - sums[1:] + 1
    if n:
        last = int(np.argmax(least <= (0 if after else 1))) if (least <= (0 if after else 1)).any() else n - 1
        start, least = start[: last + 1][::-1], np.maximum(least[: last + 1][::-1], 0 if after else 1)
    keep = np.ones(len(least), bool)
    if len(least):
        keep[:-1] = least[1:] != least[:-1]  # of equal rows the earliest counts
        least, start = least[keep], start[keep]
        x, k = out[start], made[start] + 1
        keep = np.ones(len(least), bool)
        keep[1:] = (x[1:] != x[:-1]) | (k[1:] != k[:-1])
        rows = least[keep].tolist(), x[keep].tolist(), k[keep].tolist()
    else:
        rows = [], [], []
    if not after:
        rows = [-1, *rows[0]], [int(out[0]), *rows[1]], [int(made[0]), *rows[2]]
    return rows


def _entries(ranges: list[tuple], after: bool) -> list[tuple]:
    """(key, range, tokens, shard) at the entry of each range, from its transfer table; ranges in order."""
    out, key, n, shard = [], object(), 0, 0
    for k, r, total, least, ends, made in ranges:
        if k != key:
            key, n, shard = k, 0, 0
        out.append((k, r, n, shard))
        i = int(np.searchsorted(least, n, side="right")) - 1
        if not after and n > 0 and i == 0:
            i = -1  # the row of n = 0
        if not after and n == 0:
            i = 0
        n, shard = (ends[i], shard + made[i]) if i >= 0 else (n + total, shard)
    return out


def _assigned(v: np.ndarray, n: int, shard: int, target: int, after: bool) -> tuple[np.ndarray, int, int]:
    """Shard of each row, and tokens and number of the open shard at the end."""
    at = np.empty(len(v), np.int32)
    sums = np.cumsum(v)
    i, before = 0, 0  # rows placed and their tokens
    while i < len(v):
        if after:
            j = int(np.searchsorted(sums, before + target - n, side="left")) + 1
            j = max(j, i + 1)
            at[i:j] = shard
            if j > len(v):
                n += int(sums[-1]) - before
                break
            i, before, n, shard = j, int(sums[j - 1]), 0, shard + 1
        else:
            j = int(np.searchsorted(sums, before + target - n, side="right"))
            if n == 0:
                j = max(j, int(np.searchsorted(sums, before, side="right")) + 1)
            j = min(max(j, i), len(v))
            at[i:j] = shard
            if j > i:
                n += int(sums[j - 1]) - before
                before = int(sums[j - 1])
            if j < len(v):
                n, shard = 0, shard + 1
            i = j
    return at, n, shard


def _packed(df: DataFrame, tokens: str, order: str, target: int, key: str | None, after: bool) -> DataFrame:
    """Shards of a greedy packing without a task for all rows.

    Rows are cut into ranges of about SHARDS shards.  Every range works out what it makes of any state that it may be entered with,
    a few rows each; the driver strings these together, and every range then places its own rows, a stream of batches.
    """
    if target <= 0:
        raise ValueError("the shard target must be positive")
    by = [key] if key else []
    d = df.select(*by, F.col(order).cast("bigint"), F.col(tokens).cast("bigint"), F.coalesce(F.col(tokens).cast("bigint"), F.lit(0)).alias("_v"))
    d = d if key else d.withColumn("_key", F.lit(0))
    k = key or "_key"
    kind = d.schema[k].dataType.simpleString()
    d = written(d, "sizes")  # narrow, and read four times
    total = d.agg(F.sum("_v")).first()[0] or 0
    rows = ranged(d, order, min(MOST_RANGES, max(1, total // (SHARDS * target))))

    def transfer(group: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        v = t.sort_by(order).column("_v").to_numpy()
        least, ends, made = _transfer(v, target, after)
        return pa.table({k: pa.array([group[0].as_py()], t.schema.field(k).type), "_range": pa.array([group[1].as_py()], pa.int32()), "total": [int(v.sum())], "least": [least], "ends": [ends], "made": [made]})

    found = rows.groupBy(k, "_range").applyInArrow(transfer, f"`{k}` {kind}, _range int, total bigint, least array<bigint>, ends array<bigint>, made array<bigint>").collect()
    found = sorted(map(tuple, found), key=lambda r: (r[0] is not None, r[0], r[1]))
    entry = df.sparkSession.createDataFrame(_entries(found, after), f"`{k}` {kind}, _range int, _n bigint, _shard bigint")
    e = F.broadcast(entry.withColumnRenamed(k, "_ek").withColumnRenamed("_range", "_er"))
    placed = rows.join(e, F.col(k).eqNullSafe(F.col("_ek")) & (F.col("_range") == F.col("_er"))).drop("_ek", "_er").repartition(k, "_range").sortWithinPartitions(k, "_range", order)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, shard = None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            v, r, n0, s0 = (np.asarray(b.column(c)) for c in ("_v", "_range", "_n", "_shard"))
            keys = b.column(k).dictionary_encode().indices.fill_null(-1).to_numpy()
            edges = [0, *(np.flatnonzero((r[1:] != r[:-1]) | (keys[1:] != keys[:-1])) + 1).tolist(), len(v)]
            out = np.empty(len(v), np.int32)
            for lo, hi in zip(edges, edges[1:]):
                here = b.column(k)[lo].as_py(), int(r[lo])
                if here != at:
                    at, n, shard = here, int(n0[lo]), int(s0[lo])
                out[lo:hi], n, shard = _assigned(v[lo:hi], n, shard, target, after)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*by, order, tokens)], pa.array(out)], names=[*by, order, tokens, "shard_index"])

    schema = ", ".join([*[f"`{c}` {kind}" for c in by], f"`{order}` bigint, `{tokens}` bigint, shard_index int"])
    return placed.mapInArrow(place, schema)


def pack_close_after(df: DataFrame, tokens: str, order: str, target: int) -> DataFrame:
    """(order, tokens, shard_index): a shard closes with the row that reaches the target.  Null tokens (removed rows) count 0 and ride in the open shard."""
    return _packed(df, tokens, order, target, None, True)


def pack_close_before(df: DataFrame, tokens: str, order: str, target: int, key: str = "split") -> DataFrame:
    """(key, order, tokens, shard_index): a shard closes before the row that would overfill it; an oversize row stands alone."""
    return _packed(df, tokens, order, target, key, False)
