"""Causal windows over token streams."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_sizes(docs: DataFrame) -> DataFrame:
    """(split, n): tokens of each split's stream, a row a split."""
    return docs.groupBy("split").agg(F.sum("n_tokens").alias("n"))


def sequential(docs: DataFrame, length: int) -> DataFrame:
    """(split, window_id, start, x, y): windows k = 0 .. (N-1) div T - 1 over each split's stream, across documents and shards.

    A document is sent only to the windows it overlaps (the bounds come from its own global place), so there is no range
    join; a window gathers the few pieces of its T + 1 tokens.
    """
    if length < 1:
        raise ValueError("length must be positive")
    d = docs.withColumn("windows", F.floor((F.col("stream_tokens") - 1) / length))
    s, e = F.col("global_start"), F.col("global_start") + F.col("n_tokens")
    lo = F.greatest(F.lit(0), F.ceil((s - length) / length))
    hi = F.least(F.col("windows") - 1, F.floor((e - 1) / length))
    cut = d.withColumn("_lo", lo.cast("bigint")).withColumn("_hi", hi.cast("bigint")).where("_lo <= _hi")
    rows = cut.withColumn("k", F.explode(F.sequence("_lo", "_hi")))
    first = F.greatest(F.col("k") * length, s)
    last = F.least(F.col("k") * length + length + 1, e)
    piece = F.slice("tokens", (first - s + 1).cast("int"), (last - first).cast("int"))
    w = rows.select("split", "k", F.struct(first.alias("at"), piece.alias("ids")).alias("p")).groupBy("split", "k").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    c = w.withColumn("c", F.flatten(F.transform("ps", lambda p: p["ids"])))
    return c.select("split", F.col("k").alias("window_id"), (F.col("k") * length).alias("start"), F.slice("c", 1, length).alias("x"), F.slice("c", 2, length).alias("y"))


def at_starts(docs: DataFrame, starts: DataFrame, length: int) -> DataFrame:
    """(split, sample_index, start, x, y) of windows at given starts: documents and starts meet in cells of the stream.

    Each start is sent to the cells its window touches and each document to the cells it covers, an equi-join in place of a range join.
    """
    cell = max(length + 1, 1024)
    d = docs.select("split", "global_start", "n_tokens", "tokens", F.explode(F.sequence(F.floor(F.col("global_start") / cell), F.floor((F.col("global_start") + F.col("n_tokens") - 1) / cell))).alias("cell"))
    q = starts.select("split", "sample_index", "start", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("start") + length) / cell))).alias("cell"))
    j = q.join(d, ["split", "cell"])
    first = F.greatest(F.col("start"), F.col("global_start"), F.col("cell") * cell)
    last = F.least(F.col("start") + length + 1, F.col("global_start") + F.col("n_tokens"), (F.col("cell") + 1) * cell)
    p = j.withColumn("_f", first).withColumn("_l", last).where("_f < _l").select("split", "sample_index", "start", F.struct(F.col("_f").alias("at"), F.slice("tokens", (F.col("_f") - F.col("global_start") + 1).cast("int"), (F.col("_l") - F.col("_f")).cast("int")).alias("ids")).alias("p"))
    g = p.groupBy("split", "sample_index", "start").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["ids"])).alias("c"))
    return g.select("split", "sample_index", "start", F.slice("c", 1, length).alias("x"), F.slice("c", 2, length).alias("y"))


def sample_starts(samples: DataFrame, population: Column, seed: int, epoch: int) -> DataFrame:
    """samples with start: uniform in [0, population), with replacement, from (seed, epoch, index) alone, so any index can be drawn again."""
    h = F.sha2(F.concat(F.lit(f"{seed}:{epoch}:"), F.col("sample_index").cast("string")), 256)
    return samples.withColumn("start", F.pmod(F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint"), population))


def batches(rows: DataFrame, index: str, size: int, drop_last: bool, by: list[str] | None = None, first: int | None = None) -> DataFrame:
    """(by, batch_id, samples, first_index, last_index) of consecutive batches; an incomplete last one goes or stays.

    ``first`` cuts to so many leading batches before anything is grouped, so nothing behind them is looked at.
    """
    at = F.floor(F.col(index) / size)
    d = rows if first is None else rows.where(F.col(index) < first * size)
    b = d.groupBy(*(by or []), at.alias("batch_id")).agg(F.count(F.lit(1)).alias("samples"), F.min(index).alias("first_index"), F.max(index).alias("last_index"))
    return b.where(F.col("samples") == size) if drop_last else b


def cursor(consumed: Column, total: Column, micro_batch: int, accumulation: int) -> dict[str, Column]:
    """Columns of a training stream's place: samples left, whole micro-batches and updates in them, samples that fill no update, and whether the place is valid.

    Only whole updates are taken, so a place inside an update, or past the end, is not one that a stream can be resumed at.
    """
    per = micro_batch * accumulation
    left = F.greatest(total - consumed, F.lit(0))
    return {
        "remaining": left, "micro_batches": F.floor(left / micro_batch), "updates": F.floor(left / per), "unused": left % per,
        "valid": F.coalesce((consumed >= 0) & (consumed <= total) & (consumed % per == 0), F.lit(False)),
    }


def synthetic(batches: DataFrame, stream: str, seed: int, rows: int, length: int, vocabulary: int, specials: int = 4) -> DataFrame:
    """(batch_index, row, x, y) of made-up tokens: each id comes from (stream, seed, batch, row, place) alone, so any batch can be made again."""
    at = batches.select("batch_index", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row"))

    def token(i: Column) -> Column:
        h = F.sha2(F.concat_ws(":", F.lit(stream), F.lit(str(seed)), F.col("batch_index").cast("string"), F.col("row").cast("string"), i.cast("string")), 256)
        return (F.lit(specials) + F.pmod(F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint"), F.lit(vocabulary - specials))).cast("int")

    c = at.withColumn("c", F.transform(F.sequence(F.lit(0), F.lit(length)), token))
    return c.select("batch_index", "row", F.slice("c", 1, length).alias("x"), F.slice("c", 2, length).alias("y"))


def epoch_seed(name: str, seed: int, epoch: int) -> int:
    """A non-negative 63-bit seed: the first eight bytes of sha256(name:seed:epoch), lowest byte first."""
    if epoch < 0:
        raise ValueError("epoch must not be negative")
    return int.from_bytes(hashlib.sha256(f"{name}:{seed}:{epoch}".encode()).digest()[:8], "little") & (2**63 - 1)
