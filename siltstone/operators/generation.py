"""Logits and generated tokens: filters, argmax, error and diversity statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def indexed(logits: Column) -> Column:
    """Array of (logit, -id) so that order by value breaks ties toward the smaller id."""
    return F.transform(logits, lambda v, i: F.struct(v.cast("double").alias("v"), (-i).alias("n")))


def ranked(logits: Column) -> Column:
    return F.sort_array(indexed(logits), asc=False)


def argmax(logits: Column) -> Column:
    return -F.array_max(indexed(logits))["n"]


def top_k(logits: Column, k: int) -> Column:
    """Ids of the k greatest logits, in order of falling value."""
    return F.transform(F.slice(ranked(logits), 1, k), lambda x: -x["n"])


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    z = F.transform(logits, lambda v: F.exp((v.cast("double") - F.array_max(logits).cast("double")) / temperature))
    return F.transform(z, lambda v: v / F.aggregate(z, F.lit(0.0), lambda a, x: a + x))


def nucleus(rows: DataFrame, key: str, logits: str, p: float, temperature: float = 1.0) -> DataFrame:
    """(key, token, probability) of the tokens whose more probable ones add up to p at most, at a temperature; the first always stays.

    The fold runs inside the row over its sorted list, so no row is exploded into a window.
    """
    if temperature <= 0:
        raise ValueError("the temperature must be positive")
    probs = rows.select(key, ranked(softmax(F.col(logits), temperature)).alias("r"))
    fold = F.aggregate(
        "r",
        F.struct(F.lit(0.0).alias("sum"), F.expr("cast(array() as array<struct<token:int,probability:double>>)").alias("out")),
        lambda a, x: F.struct((a["sum"] + x["v"]).alias("sum"), F.when((a["sum"] <= p) | (F.size(a["out"]) == 0), F.concat(a["out"], F.array(F.struct((-x["n"]).cast("int").alias("token"), x["v"].alias("probability"))))).otherwise(a["out"]).alias("out")),
    )
    return probs.select(key, F.explode(fold["out"]).alias("t")).select(key, "t.*")


def error_stats(a: Column, b: Column, atol: float, rtol: float) -> Column:
    """Greatest and mean difference, equal argmax, top-5 overlap, finite values, and closeness of two logit lists."""
    diff = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    near = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")) <= atol + rtol * F.abs(y.cast("double")))
    finite = F.size(F.filter(a, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return F.struct(
        F.array_max(diff).alias("max_abs"), (F.aggregate(diff, F.lit(0.0), lambda s, x: s + x) / F.size(diff)).alias("mean_abs"), (argmax(a) == argmax(b)).alias("same_argmax"),
        F.size(F.array_intersect(top_k(a, 5), top_k(b, 5))).alias("top5_overlap"), finite.alias("finite"), F.forall(near, lambda x: x).alias("close"),
    )


def overall(rows: DataFrame) -> DataFrame:
    """One row over all positions (s: error_stats, n: values): greatest and mean difference, argmax matches, least top-5 overlap, values that aren't finite, and whether all positions have one size."""
    return rows.agg(
        F.bool_and("s.same_argmax").alias("argmax_matches"), (F.sum(F.col("n") - F.col("s.finite")) == 0).alias("finite"), F.max("s.max_abs").alias("max_abs"), (F.sum(F.col("s.mean_abs") * F.col("n")) / F.sum("n")).alias("mean_abs"),
        F.min("s.top5_overlap").alias("least_top5_overlap"), F.sum(F.col("n") - F.col("s.finite")).alias("nonfinite"), (F.count_distinct("n") == 1).alias("parameters_stable"),
    )


def stop_reasons(rows: DataFrame, domain: list[str]) -> DataFrame:
    """(stop_reason, samples, tokens, passes, crops, seconds) for every reason of the domain, zeros included."""
    sums = ["tokens", "passes", "crops", "seconds"]
    n = rows.groupBy("stop_reason").agg(F.count(F.lit(1)).alias("samples"), *[F.sum(c).alias(c) for c in sums])
    d = F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in domain], "stop_reason string"))
    return d.join(n, "stop_reason", "left").select("stop_reason", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("samples", *sums)])


def diversity(tokens: Column, n: int = 2) -> Column:
    """Share of distinct n-grams, share of distinct tokens, and entropy of the token distribution in nats."""
    size = F.size(tokens)
    grams = F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.slice(tokens, i, n)))
    kinds = F.array_distinct(tokens)
    # one sort, then runs: entropy = ln(size) - sum(c ln c) / size
    runs = F.aggregate(
        F.array_sort(tokens), F.struct(F.lit(None).cast("int").alias("t"), F.lit(0).alias("c"), F.lit(0.0).alias("s")),
        lambda a, x: F.when(a["t"].eqNullSafe(x), F.struct(x.alias("t"), (a["c"] + 1).alias("c"), a["s"].alias("s"))).otherwise(F.struct(x.alias("t"), F.lit(1).alias("c"), (a["s"] + F.when(a["c"] > 0, a["c"] * F.log(a["c"].cast("double"))).otherwise(0.0)).alias("s"))),
        lambda a: a["s"] + F.when(a["c"] > 0, a["c"] * F.log(a["c"].cast("double"))).otherwise(0.0),
    )
    return F.struct((F.size(F.array_distinct(grams)) / F.size(grams)).alias("distinct_ngrams"), (F.size(kinds) / size).alias("distinct_tokens"), (F.log(size.cast("double")) - runs / size).alias("entropy"))


def sample_plan(prompts: DataFrame, decodings: DataFrame) -> DataFrame:
    """(sample_index, prompt_id, decoding_id): every prompt with every decoding, numbered prompt by prompt.

    Both sides are short lists of settings; the numbers come from ranks of each side, so no row waits for a global window.
    """
    d = decodings.select("decoding_id").distinct()
    p = prompts.select("prompt_id").distinct()
    n = d.count()
    rank = lambda df, c: df.select(c, (F.row_number().over(Window.orderBy(c)) - 1).alias("_r"))
    x = rank(p, "prompt_id").withColumnRenamed("_r", "_p").crossJoin(F.broadcast(rank(d, "decoding_id")))
    return x.select((F.col("_p") * n + F.col("_r")).alias("sample_index"), "prompt_id", "decoding_id")


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _longest(t: np.ndarray) -> int:
    """Longest run that occurs twice: keys of runs of 1, 2, 4, ... tokens by doubling, then the greatest length by its bits.

    Runs of up to four tokens have their tokens side by side in a number as a key; longer ones have ranks.
    """
    n = len(t)
    t = t.astype(np.int64)
    if n < 2:
        return 0
    if t.min() < 0 or int(t.max()) + 1 >= 1 << 15:
        t = _ranks(t)
    width = int(t.max()) + 1
    keys, bound = [t], [width]  # by level: of runs of 1, 2, 4, ... tokens, and their number
    while len(keys) < 3 and bound[-1] ** 2 < 1 << 61 and len(keys[-1]) > 1 << len(keys) - 1:
        k, step = keys[-1], 1 << len(keys) - 1
        keys.append(k[:-step] * bound[-1] + k[step:])
        bound.append(bound[-1] ** 2)
    while len(keys[-1]) > 1 << len(keys) - 1:
        r = _ranks(keys[-1])
        if r.max() + 1 == len(r):
            break
        keys[-1], bound[-1] = r, int(r.max()) + 1
        step = 1 << len(keys) - 1
        keys.append(r[:-step] * bound[-1] + r[step:])
        bound.append(bound[-1] ** 2)
    best, run, runs = 0, np.zeros(n, np.int64), 1  # run: ranks of the runs of best tokens
    for j in reversed(range(len(keys))):
        m = n - best - (1 << j) + 1
        if m > 1:
            k, b = keys[j], bound[j]
            if runs * b >= 1 << 62:
                k = _ranks(k)
                b = int(k.max()) + 1
            longer = _ranks(run[:m] * b + k[best : best + m])
            if longer.max() + 1 < m:
                best, run, runs = best + (1 << j), longer, int(longer.max()) + 1
    return best


def longest_repeats(rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, longest): length of the longest run of the whole token list that occurs twice (possibly overlapping), 0 if none does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_longest(np.asarray(t.values)) if t.is_valid else None for t in b.column(1)], pa.int32())], names=[key, "longest"])

    return rows.select(F.col(key).cast("bigint").alias(key), tokens).mapInArrow(run, f"{key} bigint, longest int")
