"""Cleaning: reasons, deduplication, splits and the counters around them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digest, has_visible, normalize_text, split_label
from ..session import written
from .ordered import pack_close_after

# Removal reasons in the order in which they are tried.
REASONS = ["missing_or_empty_text", "short_text", "non_english", "low_or_missing_language_score", "low_or_missing_quality_score", "missing_or_invalid_provided_token_count", "exact_duplicate"]
SPLITS = ["train", "validation", "test"]


@dataclass(frozen=True)
class CleanConfig:
    min_characters: int = 200
    language: str = "en"
    min_language_score: float = 0.65
    min_quality_score: int = 3
    train: float = 0.98
    validation: float = 0.01
    seed: int = 42
    check_tokens: bool = True

    def __post_init__(self) -> None:
        if self.min_characters < 1:
            raise ValueError("min_characters must be positive")
        if not 0 <= self.min_language_score <= 1:
            raise ValueError("min_language_score must lie in [0, 1]")
        if not (0 < self.train < 1 and 0 < self.validation < 1 and self.train + self.validation < 1):
            raise ValueError("train and validation ratios must leave room for test")


def nested_or_flat(column: str, present: Column, nested: Column, flat: Column) -> Column:
    """The top-level value wherever the key is present, even if null; else the nested one."""
    return F.when(present, flat).otherwise(nested).alias(column)


def reason(cfg: CleanConfig, text: Column, norm: Column, language: Column, language_score: Column, quality: Column, tokens: Column) -> Column:
    """First removal reason that applies, or null.  Emptiness is tested on the raw text, length on the cleaned one; NaN scores count as low."""
    low = lambda c, least: c.isNull() | F.isnan(c.cast("double")) | (c < least)
    out = (
        F.when(~has_visible(text), REASONS[0])
        .when(F.length(norm) < cfg.min_characters, REASONS[1])
        .when(~language.eqNullSafe(F.lit(cfg.language)), REASONS[2])
        .when(low(language_score, cfg.min_language_score), REASONS[3])
        .when(low(quality, cfg.min_quality_score), REASONS[4])
    )
    return out.when(tokens.isNull() | (tokens <= 0), REASONS[5]) if cfg.check_tokens else out


def judged(raw: DataFrame, cfg: CleanConfig) -> DataFrame:
    """Clean-record columns with text_sha256 and the reason before deduplication."""
    d = raw.withColumn("_norm", normalize_text(F.col("text")))
    d = d.withColumn("reason", reason(cfg, F.col("text"), F.col("_norm"), F.col("language"), F.col("language_score"), F.col("int_score"), F.col("token_count")))
    return d.select(
        "source_ord", "id", F.col("_norm").alias("text"), "url", "language", "language_score", F.col("int_score").cast("int").alias("quality_score"),
        F.col("token_count").cast("bigint").alias("provided_token_count"), digest(F.col("_norm")).alias("text_sha256"), "reason", F.length("_norm").alias("characters"),
    )


def keep_first(judged_rows: DataFrame, key: str = "text_sha256", order: str = "source_ord", duplicate: str = REASONS[6]) -> DataFrame:
    """Marks all but the first row of each digest, among rows without a reason.

    The first ordinals come from a map-side minimum, and a left join by digest, so a digest that a third of all rows share
    costs one aggregate row a task; the adaptive join splits its probe side.
    """
    firsts = judged_rows.where("reason is null").groupBy(key).agg(F.min(order).alias("_first"))
    j = judged_rows.join(firsts, key, "left")
    return j.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("_first") != F.col(order)), duplicate).otherwise(F.col("reason"))).drop("_first")


def not_committed(rows: DataFrame, committed: DataFrame, key: str = "text_sha256") -> DataFrame:
    """Rows whose digest is not among the committed ones; the committed side is reduced to distinct digests first."""
    return rows.join(committed.select(key).distinct(), key, "left_anti")


def with_split(rows: DataFrame, cfg: CleanConfig) -> DataFrame:
    return rows.withColumn("split", F.when(F.col("reason").isNull(), split_label(cfg.seed, F.col("text_sha256"), cfg.train, cfg.validation)))


def corpus(raw: DataFrame, cfg: CleanConfig | None = None, text: bool = True) -> DataFrame:
    """All records with text cleaned, first reason, duplicates marked, and kept rows' split.

    Cleaning is written to the shared folder once, since deduplication reads it twice; without text the table is narrow.
    """
    cfg = cfg or CleanConfig()
    j = judged(raw, cfg)
    return with_split(keep_first(written(j if text else j.drop("text"), "judged")), cfg)


def kept_records(judged_rows: DataFrame, cfg: CleanConfig) -> DataFrame:
    """The records that deduplication keeps, without their texts, for counts: (text_sha256, source_ord, provided_token_count, characters, reason, split).

    One aggregation by digest, with no join back: the first row of a digest brings its own columns along.
    """
    first = F.min_by(F.struct("source_ord", "provided_token_count", "characters"), "source_ord").alias("f")
    k = judged_rows.where("reason is null").groupBy("text_sha256").agg(first).select("text_sha256", "f.*", F.lit(None).cast("string").alias("reason"))
    return with_split(k, cfg)


def removal_totals(judged_rows: DataFrame) -> DataFrame:
    """removal_counts of rows before deduplication: kept ones are the different digests, the other rows without a reason are duplicates.  One pass, two small shuffles."""
    per = judged_rows.groupBy("reason", F.when(F.col("reason").isNull(), F.col("text_sha256")).alias("_d")).agg(F.count(F.lit(1)).alias("n"))
    a = per.groupBy("reason").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"))
    kept, twice = F.struct(F.lit("kept").alias("reason"), F.col("d").alias("records")), F.struct(F.lit(REASONS[6]).alias("reason"), (F.col("n") - F.col("d")).alias("records"))
    parts = F.when(F.col("reason").isNull(), F.array(kept, twice)).otherwise(F.array(F.struct("reason", F.col("n").alias("records"))))
    return _over_domain(a.select(F.explode(parts).alias("x")).select("x.*"))


def removal_counts(rows: DataFrame) -> DataFrame:
    """Rows by reason, with every reason of the domain and kept, zeros included."""
    return _over_domain(rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("records")))


def _over_domain(counts: DataFrame) -> DataFrame:
    domain = counts.sparkSession.createDataFrame([(r,) for r in ["kept", *REASONS]], "reason string")
    return F.broadcast(domain).join(counts, "reason", "left").select("reason", F.coalesce("records", F.lit(0)).alias("records"))


def split_totals(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    n = rows.where("reason is null").groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.sum("provided_token_count").alias("tokens"), F.sum("characters").alias("characters"))
    domain = spark.createDataFrame([(s,) for s in SPLITS], "split string")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("records", "tokens", "characters")]
    return F.broadcast(domain).join(n, "split", "left").select("split", *zero)


def retention(rows: DataFrame, digits: int = 8) -> DataFrame:
    a = rows.agg(F.count(F.lit(1)).alias("input"), F.count_if(F.col("reason").isNull()).alias("kept"))
    return a.select("input", "kept", F.when(F.col("input") == 0, F.lit(0.0)).otherwise(F.round(F.col("kept") / F.col("input"), digits)).alias("retention_rate"))


def retained(totals: DataFrame, digits: int = 8) -> DataFrame:
    """retention of the counts that removal_totals gives."""
    a = totals.agg(F.sum("records").alias("input"), F.sum(F.when(F.col("reason") == "kept", F.col("records"))).alias("kept"))
    return a.select("input", "kept", F.when(F.col("input") == 0, F.lit(0.0)).otherwise(F.round(F.col("kept") / F.col("input"), digits)).alias("retention_rate"))


def split_overlap(rows: DataFrame) -> DataFrame:
    """Digests of kept rows that occur in more than one split."""
    n = rows.where("reason is null").groupBy("text_sha256").agg(F.count_distinct("split").alias("splits"))
    return n.where("splits > 1")


def sharded(rows: DataFrame, target: int) -> DataFrame:
    """All rows with the shard of the close-after rule; removed rows go into the shard that is open at their place."""
    kept = F.when(F.col("reason").isNull(), F.col("provided_token_count")).otherwise(F.lit(0))
    shards = pack_close_after(rows.select("source_ord", kept.alias("packed_tokens")), "packed_tokens", "source_ord", target)
    return rows.join(shards, "source_ord")


def shard_metadata(rows: DataFrame) -> DataFrame:
    """Source range, kept rows, tokens and removals of each shard."""
    kept = F.col("reason").isNull()
    m = rows.groupBy("shard_index").agg(
        F.min("source_ord").alias("source_start"), (F.max("source_ord") + 1).alias("source_end"), F.count(F.lit(1)).alias("source_records"), F.count_if(kept).alias("kept_records"),
        F.sum(F.when(kept, F.col("provided_token_count")).otherwise(F.lit(0))).alias("provided_tokens"),
    )
    gone = rows.where(~kept).groupBy("shard_index", "reason").agg(F.count(F.lit(1)).alias("n"))
    maps = gone.groupBy("shard_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reason", "n"))), lambda x: F.concat(x["reason"], F.lit("="), x["n"].cast("string"))), ",").alias("removed"))
    return m.join(maps, "shard_index", "left").withColumn("removed", F.coalesce("removed", F.lit("")))


def contiguity(shards: DataFrame) -> DataFrame:
    """(shard_index, source_start, source_end, contiguous, in_sequence): whether a shard begins where the one before it ends, and whether there is one (shard 0 needs none)."""
    before = shards.select((F.col("shard_index") + 1).alias("shard_index"), F.col("source_end").alias("_end"))
    first = F.col("shard_index") == 0
    j = shards.join(before, "shard_index", "left")
    return j.select("shard_index", "source_start", "source_end", (first | F.coalesce(F.col("source_start") == F.col("_end"), F.lit(False))).alias("contiguous"), (first | F.col("_end").isNotNull()).alias("in_sequence"))


def conservation(rows: DataFrame) -> DataFrame:
    """input = kept + removed, and kept = the sum over splits."""
    a = rows.agg(F.count(F.lit(1)).alias("input"), F.count_if(F.col("reason").isNull()).alias("kept"), F.count("reason").alias("removed"), F.count("split").alias("in_splits"))
    return a.select("*", (F.col("input") == F.col("kept") + F.col("removed")).alias("rows_conserved"), (F.col("kept") == F.col("in_splits")).alias("splits_conserved"))
