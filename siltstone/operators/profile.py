"""Profiles of raw records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import digest, has_visible


def counters(raw: DataFrame) -> DataFrame:
    """Rows, empty texts, repeated raw texts and repeated ids, in one pass of aggregates."""
    text = F.when(has_visible(F.col("text")), digest(F.col("text")))
    return raw.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(~has_visible(F.col("text"))).alias("empty_texts"),
        (F.count(text) - F.count_distinct(text)).alias("duplicate_texts"),
        (F.count("id") - F.count_distinct("id")).alias("duplicate_ids"),
    )


def missing_fields(raw: DataFrame, fields: list[str]) -> DataFrame:
    """(field, missing) of the fields that are null somewhere."""
    one = raw.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in fields])
    return one.unpivot([], fields, "field", "missing").where("missing > 0")


def value_counts(raw: DataFrame, column: str, order: str = "source_ord") -> DataFrame:
    """Values by falling count, ties by first appearance, with their rank."""
    n = raw.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("records"), F.min(order).alias("first_seen"))
    return n.orderBy(F.desc("records"), "first_seen")


def numeric_summary(raw: DataFrame, columns: list[str]) -> DataFrame:
    """(field, count, minimum, maximum, mean, median), in one pass; nulls where a field has no value."""
    one = raw.agg(*[F.struct(F.count(c).alias("count"), F.min(c).cast("double").alias("minimum"), F.max(c).cast("double").alias("maximum"), F.round(F.avg(c), 2).alias("mean"), F.median(c).cast("double").alias("median")).alias(c) for c in columns])
    return one.unpivot([], columns, "field", "s").select("field", "s.*")
