"""Queries of the training-data operators, over whole tables with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crosssplit, lines, neardup, packing, quality, sites, splits, tokenize, twins, visual
from .common import read, small, spread, written


def _publisher_components(spark: SparkSession, d: str) -> DataFrame:
    rec = sites.with_site(read(spark, d, "clean_records").select("record_no", "url"), read(spark, d, "public_suffixes"))
    owners = sites.owner_table(spark, read(spark, d, "site_owners"))
    return written(splits.entity_components(rec.join(small(owners, 50_000), "site", "left"), "record_no", ["site", "owner_key"]), "publishers")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.straddling(_publisher_components(spark, d), read(spark, d, "clean_records"), "record_no")


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.grouped_splits(_publisher_components(spark, d), "record_no", read(spark, d, "split_targets")).select("record_no", "split")


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = read(spark, d, "split_targets")
    return splits.split_shares(splits.grouped_splits(_publisher_components(spark, d), "record_no", targets), targets)


def _near(spark: SparkSession, d: str, count: bool) -> DataFrame:
    return neardup.near_duplicate_groups(spread(read(spark, d, "source_records").select("source_ord", "text")), "source_ord", "text", k=3, threshold=0.6, count=count)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, False).where("first < id").select(F.col("first").alias("first_ord"), F.col("id").alias("source_ord"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, True).select(F.col("id").alias("source_ord"), F.col("rep").alias("class_ord"), "links", F.col("first").alias("first_ord"))


def p2_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.judged(spread(read(spark, d, "source_records").select("source_ord", "text")), read(spark, d, "common_words"))


def p2_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The fitted components with their kinds, and how the fit went."""
    return quality.mixture(spark, quality.fitted(spread(read(spark, d, "source_records").select("source_ord", "text")), read(spark, d, "common_words"))[1])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_stats(spark, d).where("prose_share < 0.5").select("source_ord")


def _cross(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.cross_split_pairs(spread(read(spark, d, "clean_records").select("record_no", "text", "split")), k=3, threshold=0.6)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _cross(spark, d).select(F.least("a", "b").alias("record_a"), F.greatest("a", "b").alias("record_b"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation split and site: records overlapping train, pairs, and mean coverage."""
    pairs = _cross(spark, d)
    rec = sites.with_site(read(spark, d, "clean_records").select("record_no", "split", "url"), read(spark, d, "public_suffixes"))
    each = pairs.groupBy(F.col("b").alias("record_no")).agg(F.count(F.lit(1)).alias("pairs"), F.max("coverage_b").alias("coverage"))
    return each.join(rec, "record_no").groupBy("split", "site").agg(F.count(F.lit(1)).alias("records"), F.sum("pairs").alias("pairs"), F.avg("coverage").alias("mean_coverage"))


def _lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rec = sites.with_site(spread(read(spark, d, "source_records").select("source_ord", "url", "text", "crawled_at")), read(spark, d, "public_suffixes"))
    return rec, lines.excessive_lines(rec)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d)[1].select(F.col("id").alias("source_ord"), "line_no")


def p5_texts(spark: SparkSession, d: str) -> DataFrame:
    return lines.without_lines(*_lines(spark, d))


def p5_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    """Places of lines that also stand in at least 8 different documents of the site, on at least two days: republished articles don't count."""
    rec = sites.with_site(spread(read(spark, d, "source_records").select("source_ord", "url", "text", "crawled_at")), read(spark, d, "public_suffixes"))
    return lines.excessive_lines(rec, clusters_least=8, days_least=2).select(F.col("id").alias("source_ord"), "line_no", "records", "clusters", "days", "site_records")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "documents").select("doc_id", "text"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encoded(_documents(spark, d))


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    sizes = written(tokenize.token_counts(_documents(spark, d)), "sizes")
    return packing.packed(sizes, read(spark, d, "pack_profiles"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_packing(spark, d), read(spark, d, "pack_profiles"))


def p7_search(spark: SparkSession, d: str) -> DataFrame:
    """Blocks, proofs, containers against best fit and bound, and steps of the search, by profile."""
    return packing.search_report(written(tokenize.token_counts(_documents(spark, d)), "sizes"), read(spark, d, "pack_profiles"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return visual.same_looking_pairs(_documents(spark, d))


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    return visual.forms(_documents(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_splits, p1_shares, p2_found, p2_stats, p2_mixture, p3_found, p3_report, p4_found, p4_groups, p5_found, p5_boilerplate, p5_texts, p6_ids, p7_packing, p7_report, p7_search, p8_found, p8_forms)}

SQL: dict[str, str] = dict(twins.SQL)
