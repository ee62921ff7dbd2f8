"""Token documents: statistics, offsets, index checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import code_points, ratio
from ..session import written

# Special ids and vocabulary size.
SPECIALS = {"bos": 0, "eos": 1, "pad": 2, "unk": 3}
VOCABULARY = 16_384


def code_point_ids(text: Column) -> Column:
    """Ids of the deterministic stand-in tokenizer: 100 + code point mod 97, then the end id."""
    return F.concat(F.transform(code_points(text), lambda c: (F.lit(100) + c % 97).cast("int")), F.array(F.lit(SPECIALS["eos"])))


def token_documents(clean: DataFrame, encode=code_point_ids) -> DataFrame:
    """(split, shard_index, doc_ord, text_sha256, provided_tokens, characters, bytes, tokens, n_tokens)."""
    d = clean.where("text is not null and split is not null")
    return d.select(
        "record_no", "split", "shard_index", (F.col("line_number") - 1).alias("doc_ord"), F.sha2("text", 256).alias("text_sha256"), F.col("provided_token_count").alias("provided_tokens"),
        F.length("text").alias("characters"), F.octet_length("text").alias("bytes"), encode(F.col("text")).alias("tokens"),
    ).withColumn("n_tokens", F.size("tokens"))


def document_checks(docs: DataFrame, vocabulary: int = VOCABULARY) -> DataFrame:
    """Why a token document is invalid: too short, no end id, out of range, or an unknown id; null where it is valid."""
    t = F.col("tokens")
    why = (
        F.when(F.size(t) < 2, "too_short").when(F.element_at(t, -1) != SPECIALS["eos"], "no_end")
        .when((F.array_min(t) < 0) | (F.array_max(t) >= vocabulary), "out_of_range").when(F.array_contains(t, SPECIALS["unk"]), "unknown_id")
    )
    return docs.withColumn("violation", why)


def split_statistics(docs: DataFrame, context: int = 512, by: list[str] | None = None) -> DataFrame:
    """Counts, lengths and ratios of each split; ratios are made from sums, percentiles are interpolated."""
    by = ["split"] if by is None else by
    n = F.col("n_tokens")
    a = docs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"), F.sum("characters").alias("characters"), F.sum("bytes").alias("utf8_bytes"), F.sum("n_tokens").alias("tokens"), F.sum("provided_tokens").alias("provided"),
        F.min(F.array_min("tokens")).alias("min_id"), F.max(F.array_max("tokens")).alias("max_id"), F.avg("n_tokens").alias("mean_length"),
        F.expr("percentile(n_tokens, 0.5)").alias("p50"), F.expr("percentile(n_tokens, 0.95)").alias("p95"), F.expr("percentile(n_tokens, 0.99)").alias("p99"), F.count_if(n > context).alias("over_context"),
    )
    return a.select(
        "*", ratio(F.col("characters"), F.col("tokens")).alias("characters_per_token"), ratio(F.col("utf8_bytes"), F.col("tokens")).alias("bytes_per_token"),
        ratio(F.col("tokens"), F.col("provided")).alias("model_per_provided"), ratio(F.col("over_context"), F.col("records")).alias("over_context_ratio"),
    )


def special_counts(docs: DataFrame) -> DataFrame:
    """Occurrences of each special id by split."""

    def occurrences(i: int):
        return F.sum(F.size(F.filter("tokens", lambda t: t == i)))

    return docs.groupBy("split").agg(*[occurrences(i).alias(k) for k, i in SPECIALS.items()])


def statistics_rollup(docs: DataFrame) -> DataFrame:
    """Mergeable sums by shard, by split and in total (null keys), with extreme ids."""
    return docs.rollup("split", "shard_index").agg(
        F.count(F.lit(1)).alias("records"), F.sum("n_tokens").alias("model_tokens"), F.sum(F.col("n_tokens") - 1).alias("raw_tokens"), F.count_if(F.element_at("tokens", -1) == 1).alias("end_tokens"),
        F.min(F.array_min("tokens")).alias("min_id"), F.max(F.array_max("tokens")).alias("max_id"),
    )


def offsets(docs: DataFrame) -> DataFrame:
    """docs with start_token within the shard, global_start within the split's stream, and stream_tokens, the stream's length.

    docs is written once, so text is tokenized once; running sums see lengths alone, and token lists are joined to
    them by a row number.  Shards are bounded in tokens by their packing, so the window's partitions are bounded too.
    """
    t = written(docs.withColumn("_row", F.monotonically_increasing_id()), "tokens")
    n = t.select("_row", "split", "shard_index", "doc_ord", "n_tokens")
    shard = Window.partitionBy("split", "shard_index").orderBy("doc_ord", "_row").rowsBetween(Window.unboundedPreceding, -1)
    d = n.withColumn("start_token", F.coalesce(F.sum("n_tokens").over(shard), F.lit(0)))
    before = Window.partitionBy("split").orderBy("shard_index").rowsBetween(Window.unboundedPreceding, -1)  # a row per storage shard
    sums = n.groupBy("split", "shard_index").agg(F.sum("n_tokens").alias("_n"))
    base = sums.select("split", "shard_index", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy("split")).alias("stream_tokens"))
    placed = d.join(base, ["split", "shard_index"]).select("_row", "start_token", (F.col("_base") + F.col("start_token")).alias("global_start"), "stream_tokens")
    return t.join(placed, "_row").drop("_row")


def document_starts(shards: DataFrame) -> DataFrame:
    """shards (split, shard_index, documents) with the documents of all earlier shards of the split."""
    before = Window.partitionBy("split").orderBy("shard_index").rowsBetween(Window.unboundedPreceding, -1)  # a row per storage shard
    return shards.withColumn("document_start", F.coalesce(F.sum("documents").over(before), F.lit(0)))


def shard_equalities(docs: DataFrame, stated: DataFrame) -> DataFrame:
    """Shards, splits and the total against stated sums of their parts: (level, split, shard_index, documents, tokens, stated_documents,
    stated_tokens, equal).  stated has split, shard_index, documents and tokens of each shard; levels above are its sums."""
    mine = docs.rollup("split", "shard_index").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"), F.grouping_id().alias("g"))
    theirs = stated.rollup("split", "shard_index").agg(F.sum("documents").alias("stated_documents"), F.sum("tokens").alias("stated_tokens"), F.grouping_id().alias("g"))
    a, b = mine.alias("a"), theirs.alias("b")
    same = F.col("a.split").eqNullSafe(F.col("b.split")) & F.col("a.shard_index").eqNullSafe(F.col("b.shard_index")) & (F.col("a.g") == F.col("b.g"))
    level = F.element_at(F.array(F.lit("shard"), F.lit("split"), F.lit("total"), F.lit("total")), F.coalesce("a.g", "b.g").cast("int") + 1)
    equal = F.col("documents").eqNullSafe(F.col("stated_documents")) & F.col("tokens").eqNullSafe(F.col("stated_tokens"))
    return a.join(b, same, "full").select(
        level.alias("level"), F.coalesce("a.split", "b.split").alias("split"), F.coalesce("a.shard_index", "b.shard_index").alias("shard_index"), "documents", "tokens", "stated_documents", "stated_tokens", equal.alias("equal")
    )


def index_gaps(index: DataFrame) -> DataFrame:
    """Entries that don't begin where the one before ends: gap, overlap, repeated place, or no length.

    Shards are bounded in tokens by the sink, so the window's partitions are bounded too.
    """
    w = Window.partitionBy("split", "shard_index").orderBy("doc_ord", "start_token", F.hex("text_sha256"))
    d = index.withColumn("expected", F.coalesce(F.lag(F.col("start_token") + F.col("length_tokens")).over(w), F.lit(0))).withColumn("_prev", F.lag("doc_ord").over(w))
    why = F.when(F.col("length_tokens") <= 0, "zero_length").when(F.col("_prev") == F.col("doc_ord"), "repeated").when(F.col("start_token") < F.col("expected"), "overlap").when(F.col("start_token") > F.col("expected"), "gap")
    return d.withColumn("violation", why).where("violation is not null").select("split", "shard_index", "doc_ord", "start_token", "length_tokens", "expected", "violation")


def index_binding(index: DataFrame, clean: DataFrame) -> DataFrame:
    """Index entries whose digest is not that of the record at their place, and places without one on either side."""
    c = clean.select("split", "shard_index", (F.col("line_number") - 1).alias("doc_ord"), F.sha2("text", 256).alias("actual"))
    i = index.select("split", "shard_index", "doc_ord", F.lower(F.hex("text_sha256")).alias("indexed"))
    j = i.join(c, ["split", "shard_index", "doc_ord"], "full")
    why = F.when(F.col("indexed").isNull(), "not_indexed").when(F.col("actual").isNull(), "no_record").when(F.col("indexed") != F.col("actual"), "other_text")
    return j.withColumn("violation", why).groupBy(F.coalesce("violation", F.lit("ok")).alias("violation")).agg(F.count(F.lit(1)).alias("entries"))


def token_conservation(docs: DataFrame) -> DataFrame:
    """records = end ids, raw + end = model, no other special id, least <= greatest."""
    s = lambda i: F.sum(F.size(F.filter("tokens", lambda t: t == i)))
    a = docs.agg(F.count(F.lit(1)).alias("records"), F.sum("n_tokens").alias("model"), F.sum(F.col("n_tokens") - 1).alias("raw"), s(1).alias("eos"), (s(0) + s(2) + s(3)).alias("others"), F.min(F.array_min("tokens")).alias("lo"), F.max(F.array_max("tokens")).alias("hi"))
    ok = (F.col("records") == F.col("eos")) & (F.col("raw") + F.col("eos") == F.col("model")) & (F.col("others") == 0) & (F.col("lo") <= F.col("hi"))
    return a.select("records", "model", "raw", "eos", "others", ok.alias("conserved"))


def shard_of_position(positions: DataFrame, shards: DataFrame) -> DataFrame:
    """The shard that holds each position of a split's stream; shards are few (storage units) and are sent only if they are."""
    few = F.broadcast(shards) if len(shards.limit(10_001).select("split").take(10_001)) <= 10_000 else shards
    p, s = positions.alias("p"), few.alias("s")
    inside = (F.col("p.split") == F.col("s.split")) & (F.col("p.position") >= F.col("s.start")) & (F.col("p.position") < F.col("s.start") + F.col("s.tokens"))
    return p.join(s, inside).select("p.split", "p.position", "s.shard_index", (F.col("p.position") - F.col("s.start")).alias("local_position"))
