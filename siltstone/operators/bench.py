"""Benchmark rows: summaries, pairs, gates, plans, telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Signs of an exhausted device in an error message.
OOM_SIGNS = ["out of memory", "cuda error: out of memory", "cublas_status_alloc_failed", "cudnn_status_alloc_failed"]


def usable(c: Column, signed: bool = False) -> Column:
    """A finite measurement; negative ones only if signed."""
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return ok if signed else ok & (c >= 0)


def summary(rows: DataFrame, by: list[str], metric: str) -> DataFrame:
    """Count, mean, interpolated median, nearest-rank p95, least and greatest of measured rows; warm-ups stay out."""
    m = rows.where((F.col("phase") != "warmup") & usable(F.col(metric)))
    return m.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"), F.avg(metric).alias("mean"), F.median(metric).alias("median"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {metric})").alias("p95"), F.min(metric).alias("minimum"), F.max(metric).alias("maximum"),
    )


def paired(rows: DataFrame, key: list[str], strategy: str, value: str, a: str, b: str) -> DataFrame:
    """One row per key with the values of both strategies; keys without exactly one of each are marked incomplete."""
    p = rows.groupBy(*key).agg(F.max(F.when(F.col(strategy) == a, F.col(value))).alias("a"), F.max(F.when(F.col(strategy) == b, F.col(value))).alias("b"), F.count(F.lit(1)).alias("n"))
    ok = (F.col("n") == 2) & F.col("a").isNotNull() & F.col("b").isNotNull()
    speed = F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != 0) & (F.col("b") != 0), F.col("b") / F.col("a"))
    return p.select(*key, F.col("a").alias(a), F.col("b").alias(b), speed.alias("speedup"), ok.alias("complete"))


def adoption(pairs: DataFrame, by: str, gate: float) -> DataFrame:
    """Mean speed-up of each group and whether it passes; a group without a value fails."""
    g = pairs.groupBy(by).agg(F.avg("speedup").alias("mean_speedup"))
    return g.withColumn("adopted", F.coalesce(F.col("mean_speedup") >= gate, F.lit(False)))


def series_delta(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """First, last, difference, least, greatest, and whether the series never falls and grows at all."""
    w = Window.partitionBy(by).orderBy(order)
    d = rows.withColumn("_up", F.col(value) - F.lag(value).over(w))
    a = d.groupBy(by).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.min(value).alias("minimum"), F.max(value).alias("maximum"), (F.coalesce(F.bool_and(F.col("_up") >= 0), F.lit(True)) & F.coalesce(F.bool_or(F.col("_up") > 0), F.lit(False))).alias("monotone_growth"))
    return a.withColumn("delta", F.col("last") - F.col("first"))


def best_candidate(rows: DataFrame, by: list[str], limit: float) -> DataFrame:
    """Of the candidates that ran within the memory limit, the one with the largest micro-batch, then throughput, then first."""
    ok = rows.where((F.col("status") == "ok") & (F.col("peak_fraction") <= limit))
    return ok.groupBy(*by).agg(F.max_by(F.struct("candidate", "micro_batch", "rate"), F.struct("micro_batch", "rate", -F.col("candidate"))).alias("best")).select(*by, "best.*")


def best_loader(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of the candidates that ran, the fastest; of equal ones the first."""
    ok = rows.where((F.col("status") == "ok") & usable(F.col("rate")))
    return ok.groupBy(*by).agg(F.max_by(F.struct("candidate", "rate"), F.struct("rate", -F.col("candidate"))).alias("best")).select(*by, "best.*")


def loader_grid(workers: DataFrame, pins: list[bool], micro_batch: int, accumulation: int) -> DataFrame:
    """(ordinal, key, workers, pin_memory, repeated): every number of workers with every pin setting, in the order given (workers: ordinal, workers).

    repeated marks candidates whose key an earlier one has; a valid grid has none.  Both sides are short lists of settings.
    """
    p = F.explode(F.array(*[F.struct(F.lit(i).alias("_p"), F.lit(x).alias("pin_memory")) for i, x in enumerate(pins)]))
    g = workers.select("ordinal", "workers", p.alias("x")).select((F.col("ordinal") * len(pins) + F.col("x._p")).alias("ordinal"), "workers", "x.pin_memory")
    key = F.format_string("b%d-a%d-w%d-p%d", F.lit(micro_batch), F.lit(accumulation), "workers", F.col("pin_memory").cast("int"))
    first = g.withColumn("key", key)
    return first.select("ordinal", "key", "workers", "pin_memory", (F.row_number().over(Window.partitionBy("key").orderBy("ordinal")) > 1).alias("repeated"))


def run_plan(prompts: DataFrame, strategies: list[str], warmups: int, measured: int) -> DataFrame:
    """Requests in order: warm-ups, then measured ones, prompts in rotation, strategies alternating within a pair."""
    n = prompts.count()
    total = warmups + measured
    r = prompts.sparkSession.range(total).withColumnRenamed("id", "pair_index").withColumn("prompt_index", F.col("pair_index") % max(1, n))
    r = r.crossJoin(F.broadcast(prompts.sparkSession.createDataFrame([(i, s) for i, s in enumerate(strategies)], "strategy_index int, strategy string")))
    k = len(strategies)
    order = F.when(F.col("pair_index") % 2 == 0, F.col("strategy_index")).otherwise(k - 1 - F.col("strategy_index"))
    return r.select(
        (F.col("pair_index") * k + order).alias("sequence_index"), "pair_index", F.when(F.col("pair_index") < warmups, "warmup").otherwise("measured").alias("phase"),
        F.when(F.col("pair_index") < warmups, F.col("pair_index")).otherwise(F.col("pair_index") - warmups).alias("phase_index"), "prompt_index", "strategy",
    )


def telemetry(lines: DataFrame, line: str, patterns: dict[str, str]) -> DataFrame:
    """Greatest number that each pattern's first group finds anywhere in the log; null where it finds none."""
    found = lines.select(*[F.array_max(F.transform(F.regexp_extract_all(line, F.lit(p), F.lit(1)), lambda x: x.cast("double"))).alias(n) for n, p in patterns.items()])
    return found.agg(*[F.max(n).alias(n) for n in patterns])


def gates(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(gate, passed) of named checks that must hold in every row; a null fails, no rows pass nothing."""
    one = rows.agg(*[F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(False)).alias(n) for n, c in checks.items()])
    return one.unpivot([], list(checks), "gate", "passed")


def oom(message: Column) -> Column:
    return F.coalesce(F.lower(message).rlike("|".join(OOM_SIGNS)), F.lit(False))
