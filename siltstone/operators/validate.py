"""Validation of corpora, indexes, manifests and runs: every check is a column or a join, and its result a table of rules or violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import close


def rules(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(rule, checked, failed) of conditions that must hold in every row; a null fails."""
    one = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()], F.count(F.lit(1)).alias("checked"))
    return one.unpivot(["checked"], list(checks), "rule", "failed").select("rule", "checked", "failed")


def shard_files(records: DataFrame) -> DataFrame:
    """(path, shard_index, split, records, provided_tokens, bytes, sha256) of each shard's files.

    A file is its records' texts, a line each, in order of line_number; its digest is that of the records' digests in this order.
    Only digests are gathered, one file's at a time, and files are bounded by the shard target.  Records without a shard or a split are in no file.
    """
    d = records.where("shard_index is not null and split is not null").select("shard_index", "split", "line_number", "provided_token_count", F.octet_length("text").alias("b"), F.coalesce(F.sha2("text", 256), F.lit("")).alias("h"))
    a = d.groupBy("shard_index", "split").agg(
        F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("provided_token_count"), F.lit(0)).alias("provided_tokens"), F.sum(F.coalesce("b", F.lit(0)) + 1).alias("bytes"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "h"))), lambda x: x["h"]), ""), 256).alias("sha256"),
    )
    return a.select(F.format_string("shards/shard-%05d/%s.jsonl", "shard_index", "split").alias("path"), "*")


def file_differences(registered: DataFrame, found: DataFrame) -> DataFrame:
    """(path, state) of files that aren't the same on both sides: missing, extra, size or digest.  Both have path, records and sha256."""
    a, b = registered.select("path", F.col("records").alias("ra"), F.col("sha256").alias("ha")), found.select("path", F.col("records").alias("rb"), F.col("sha256").alias("hb"))
    state = F.when(F.col("rb").isNull(), "missing").when(F.col("ra").isNull(), "extra").when(F.col("ra") != F.col("rb"), "size").when(~F.col("ha").eqNullSafe(F.col("hb")), "digest")
    return a.join(b, "path", "full").select("path", state.alias("state")).where("state is not null")


def manifest_rules(shards: DataFrame, splits: DataFrame, target: int | None = None) -> DataFrame:
    """(rule, checked, failed) of a corpus manifest.

    shards has shard_index, source_start, source_end (past the last), source_records, kept_records, provided_tokens and removed_records;
    splits has split, records and tokens.  Indexes count from 0, ranges follow one another, records are conserved in
    every shard, shards add up to splits, all splits have records, and the token target, if there is one, is reached.
    """
    w = Window.orderBy("shard_index")  # a row per storage shard
    s = shards.withColumn("_n", F.row_number().over(w) - 1).withColumn("_end", F.coalesce(F.lag("source_end").over(w), F.col("source_start")))
    each = rules(
        s,
        {
            "contiguous_indexes": F.col("shard_index") == F.col("_n"), "contiguous_ranges": F.col("source_start") == F.col("_end"), "range_not_empty": F.col("source_end") > F.col("source_start"),
            "records_conserved": F.col("source_records") == F.col("kept_records") + F.col("removed_records"),
        },
    )
    total = shards.agg(F.sum("kept_records").alias("kept"), F.sum("provided_tokens").alias("tokens"))
    parts = splits.agg(F.sum("records").alias("in_splits"), F.sum("tokens").alias("split_tokens"))
    checks = {"shards_add_up_to_splits": (F.col("kept") == F.col("in_splits")) & (F.col("tokens") == F.col("split_tokens"))}
    if target is not None:
        checks["target_reached"] = F.col("tokens") >= target
    return each.union(rules(splits, {"split_not_empty": F.col("records") > 0})).union(rules(total.join(F.broadcast(parts)), checks))


def stream_rules(shards: DataFrame) -> DataFrame:
    """(rule, checked, failed) of a token corpus by shard: split, shard_index, documents, tokens, token_start, document_start (global prefixes of the
    split), ends (end ids), least and greatest id."""
    w = Window.partitionBy("split").orderBy("shard_index")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    s = shards.withColumn("_n", F.row_number().over(w) - 1).withColumn("_t", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn("_d", F.coalesce(F.sum("documents").over(before), F.lit(0)))
    return rules(
        s,
        {
            "contiguous_shards": F.col("shard_index") == F.col("_n"), "token_prefix": F.col("token_start") == F.col("_t"), "document_prefix": F.col("document_start") == F.col("_d"),
            "an_end_per_document": F.col("ends") == F.col("documents"), "least_within_greatest": (F.col("least") >= 0) & (F.col("least") <= F.col("greatest")), "not_empty": (F.col("documents") > 0) & (F.col("tokens") >= 2 * F.col("documents")),
        },
    )


def header_differences(statistics: DataFrame, headers: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """(by, field, actual, stated) where a shard's statistics differ from its header; a shard on one side only differs in every field."""
    a = statistics.select(*by, F.struct(*[F.col(f).cast("bigint").alias(f) for f in fields]).alias("a"))
    b = headers.select(*by, F.struct(*[F.col(f).cast("bigint").alias(f) for f in fields]).alias("b"))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col("a")[f].alias("actual"), F.col("b")[f].alias("stated")) for f in fields])
    x = a.join(b, by, "full").select(*by, F.explode(pairs).alias("x")).select(*by, "x.*")
    return x.where(~F.col("actual").eqNullSafe(F.col("stated")))


def token_at(docs: DataFrame, positions: DataFrame, by: list[str], cell: int = 1024) -> DataFrame:
    """positions (by, position) with the token there, null outside all documents; docs has by, start_token, n_tokens and tokens.

    Documents and positions meet in cells of the stream, an equi-join; a document is cut into its cells' pieces first.
    """
    s, n = F.col("start_token"), F.col("n_tokens")
    pieces = docs.where("n_tokens > 0").withColumn("_cell", F.explode(F.sequence(F.floor(s / cell), F.floor((s + n - 1) / cell))))
    first = F.greatest(s, F.col("_cell") * cell)
    last = F.least(s + n, (F.col("_cell") + 1) * cell)
    pieces = pieces.select(*by, "_cell", first.alias("_f"), last.alias("_l"), F.slice("tokens", (first - s + 1).cast("int"), (last - first).cast("int")).alias("_t"))
    p = positions.select(*by, "position").distinct().withColumn("_cell", F.floor(F.col("position") / cell))
    hit = p.join(pieces, [*by, "_cell"]).where("position >= _f and position < _l").select(*by, "position", F.element_at("_t", (F.col("position") - F.col("_f") + 1).cast("int")).alias("token"))
    return positions.join(hit.groupBy(*by, "position").agg(F.max("token").alias("token")), [*by, "position"], "left")


def end_tokens(index: DataFrame, docs: DataFrame, end_id: int = 1) -> DataFrame:
    """(split, shard_index, doc_ord, start_token, length_tokens, token, ends): each index entry with the token at its last place, and whether it is the end id."""
    by = ["split", "shard_index"]
    p = index.select(*by, "doc_ord", "start_token", "length_tokens", (F.col("start_token") + F.col("length_tokens") - 1).alias("position"))
    t = token_at(docs, p.select(*by, "position"), by)
    return p.join(t.distinct(), [*by, "position"], "left").select(*by, "doc_ord", "start_token", "length_tokens", "token", F.coalesce(F.col("token") == end_id, F.lit(False)).alias("ends"))


def config_violations(flat: DataFrame, contract: list[tuple[str, str, float | None, float | None]], by: str) -> DataFrame:
    """(by, path, violation) of flattened configurations (by, path, value, type) against a contract of (path, type, least, greatest).

    The contract's paths are the only ones allowed (unexpected), all of them must be there (missing), with their type and within
    their bounds (range).  The contract is a short list.
    """
    spark = flat.sparkSession
    want = F.broadcast(spark.createDataFrame(contract, "path string, kind string, least double, greatest double"))
    every = flat.select(by).distinct().join(want)
    j = flat.join(every, [by, "path"], "full")
    number = F.expr("try_cast(value as double)")
    why = (
        F.when(F.col("kind").isNull(), "unexpected").when(F.col("type").isNull(), "missing").when(F.col("type") != F.col("kind"), "type")
        .when((F.col("least").isNotNull() & ~F.coalesce(number >= F.col("least"), F.lit(False))) | (F.col("greatest").isNotNull() & ~F.coalesce(number <= F.col("greatest"), F.lit(False))), "range")
    )
    return j.select(by, "path", why.alias("violation")).where("violation is not null")


def ablation(differences: DataFrame, held: DataFrame, pairs: DataFrame, by: str, changed: str) -> DataFrame:
    """(by, differing, only_changed, held, valid) of each pair of configurations: exactly one path differs, the stated one, and the held paths are equal.

    differences: (by, path); held: (by, path, held); pairs: every by.
    """
    d = differences.groupBy(by).agg(F.count(F.lit(1)).alias("differing"), F.bool_and(F.col("path") == changed).alias("only_changed"))
    h = held.groupBy(by).agg(F.bool_and("held").alias("held"))
    j = pairs.select(by).join(d, by, "left").join(h, by, "left")
    n = F.coalesce("differing", F.lit(0))
    return j.select(by, n.alias("differing"), F.coalesce("only_changed", F.lit(False)).alias("only_changed"), F.coalesce("held", F.lit(False)).alias("held"), ((n == 1) & F.coalesce("only_changed", F.lit(False)) & F.coalesce("held", F.lit(False))).alias("valid"))


def decision(measures: DataFrame, limits: dict[str, tuple[str, float | bool]]) -> DataFrame:
    """(gate, passed) of a one-row table of measures against limits: {measure: ("<=" | ">=" | "==", limit)}.  A null measure fails; no row passes nothing."""
    signs = {"<=": lambda c, x: c <= x, ">=": lambda c, x: c >= x, "==": lambda c, x: c == x}
    one = measures.agg(*[F.coalesce(F.bool_and(F.coalesce(signs[op](F.col(m), F.lit(x)), F.lit(False))), F.lit(False)).alias(m) for m, (op, x) in limits.items()])
    return one.unpivot([], list(limits), "gate", "passed")


def run_rows(rows: DataFrame, plan: DataFrame, rel: float = 1e-12) -> DataFrame:
    """(sequence_index, violation) of published requests against their plan; null where a row is as planned and measured.

    rows: sequence_index, pair_index, strategy, prompt_tokens, generated, returned, prefill, ttft, wall, decode_rate; plan: sequence_index, planned.
    """
    ok = lambda c: F.coalesce(c, F.lit(False))
    pair = rows.groupBy("pair_index").agg(F.count_distinct("strategy").alias("_k"), F.count(F.lit(1)).alias("_n"), F.min("generated").alias("_lo"), F.max("generated").alias("_hi"))
    j = rows.join(pair, "pair_index").join(plan, "sequence_index", "full")
    rate = F.when((F.col("generated") > 1) & (F.col("wall") > F.col("ttft")), (F.col("generated") - 1) / (F.col("wall") - F.col("ttft")))
    why = (
        F.when(F.col("planned").isNull(), "unplanned").when(F.col("strategy").isNull(), "missing").when(F.col("strategy") != F.col("planned"), "strategy")
        .when(~ok(F.col("returned") == F.col("prompt_tokens") + F.col("generated")), "returned").when(~ok((F.col("prefill") <= F.col("ttft")) & (F.col("ttft") <= F.col("wall"))), "times")
        .when(~(rate.isNull() & F.col("decode_rate").isNull() | ok(close(rate, F.col("decode_rate"), rel, 0.0))), "rate").when(~ok((F.col("_k") == 2) & (F.col("_n") == 2) & (F.col("_lo") == F.col("_hi"))), "pair")
    )
    return j.select("sequence_index", why.alias("violation"))
