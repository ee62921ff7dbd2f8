"""Metric logs: weighted losses, running values, order checks, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def weighted_loss(rows: DataFrame, by: list[str]) -> DataFrame:
    """Token-weighted mean loss and its perplexity (infinite where it overflows); null where no tokens were seen."""
    a = rows.groupBy(*by).agg(F.sum(F.col("loss") * F.col("tokens")).alias("_l"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("batches"))
    loss = F.when(F.col("tokens") > 0, F.col("_l") / F.col("tokens"))
    return a.select(*by, "batches", "tokens", loss.alias("loss"), F.exp(loss).alias("perplexity"))


def running_best(rows: DataFrame, run: str = "run", step: str = "step", loss: str = "loss") -> DataFrame:
    """Best and last loss up to each evaluation, and whether the row is a new best."""
    w = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(run, step, F.col(loss).alias("last_loss"), F.min(loss).over(w).alias("best_loss"), (F.min(loss).over(before).isNull() | (F.col(loss) < F.min(loss).over(before))).alias("improved"))


def cumulative(rows: DataFrame, run: str = "run", step: str = "step") -> DataFrame:
    """Counters after each update: updates, tokens and seconds so far."""
    w = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(run, step, F.row_number().over(Window.partitionBy(run).orderBy(step)).alias("updates"), F.sum("tokens").over(w).alias("tokens_seen"), F.sum("elapsed").over(w).alias("seconds"))


def step_regressions(rows: DataFrame, order: str, step: str = "step", run: str = "run") -> DataFrame:
    """Lines whose step is below one that was logged before; lines without a step are passed over."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(step).over(w)
    return rows.where(F.col(step).isNotNull()).withColumn("highest_before", top).where(F.col(step) < F.col("highest_before"))


def resume_violations(rows: DataFrame, checkpoints: DataFrame, run: str = "run", step: str = "step") -> DataFrame:
    """Logged events newer than their run's checkpoint."""
    return rows.join(checkpoints, run).where(F.col(step) > F.col("checkpoint_step"))


def due(step: Column, every: int, last: Column) -> Column:
    """An event is due at the first step, at each multiple of the interval, and at the last step."""
    return (step == 1) | (step % every == 0) | (step == last)


def throughput(rows: DataFrame, by: list[str], step: str = "step") -> DataFrame:
    """Tokens a second from sums, and the median of single steps without the first one."""
    rate = F.when((F.col("elapsed") > 0) & (F.col(step) > 1), F.col("tokens") / F.col("elapsed"))
    a = rows.groupBy(*by).agg(F.sum("tokens").alias("tokens"), F.sum("elapsed").alias("seconds"), F.median(rate).alias("median_rate"))
    return a.select(*by, "tokens", "seconds", F.when(F.col("seconds") > 0, F.col("tokens") / F.col("seconds")).alias("rate"), "median_rate")
