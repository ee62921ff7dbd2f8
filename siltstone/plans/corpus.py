"""Queries over raw and clean records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import clean as C
from ..operators import ordered, profile
from ..session import written
from .base import RAW_COLUMNS, VISIBLE, clean, corpus_sql, fraction_sql, judged_sql, norm_sql, query, raw, table

WIDE = C.CleanConfig(train=0.8, validation=0.1)
REASON_DOMAIN = "(VALUES " + ", ".join(f"('{r}')" for r in ["kept", *C.REASONS]) + ") AS dom(reason)"
SPLIT_DOMAIN = "(VALUES ('train'), ('validation'), ('test')) AS dom(split)"


@query(f"""SELECT count(*) AS records, count(*) FILTER (WHERE NOT {VISIBLE}) AS empty_texts,
 count(CASE WHEN {VISIBLE} THEN text END) - count(DISTINCT CASE WHEN {VISIBLE} THEN sha256(text) END) AS duplicate_texts, count(id) - count(DISTINCT id) AS duplicate_ids FROM source_records""")
def profile_counters(spark: SparkSession, d: str) -> DataFrame:
    return profile.counters(raw(spark, d))


@query("SELECT field, missing FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) - count({c}) AS missing FROM source_records" for c in RAW_COLUMNS) + ") WHERE missing > 0")
def profile_missing_fields(spark: SparkSession, d: str) -> DataFrame:
    return profile.missing_fields(raw(spark, d), RAW_COLUMNS)


@query("SELECT language::VARCHAR AS value, count(*) AS records, min(source_ord) AS first_seen FROM source_records GROUP BY 1")
def profile_language_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.value_counts(raw(spark, d), "language")


@query("SELECT int_score::VARCHAR AS value, count(*) AS records, min(source_ord) AS first_seen FROM source_records GROUP BY 1")
def profile_score_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.value_counts(raw(spark, d), "int_score")


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS count, min({c})::DOUBLE AS minimum, max({c})::DOUBLE AS maximum, round(avg({c}), 2) AS mean, median({c})::DOUBLE AS median FROM source_records" for c in ("language_score", "int_score", "token_count")))
def profile_numeric_summary(spark: SparkSession, d: str) -> DataFrame:
    return profile.numeric_summary(raw(spark, d), ["language_score", "int_score", "token_count"])


@query(f"SELECT source_ord, {norm_sql('text')} AS text FROM source_records")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select("source_ord", T.normalize_text(F.col("text")).alias("text"))


@query("SELECT source_ord, sha256(text) AS digest FROM source_records")
def text_digest(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select("source_ord", T.digest(F.col("text")).alias("digest"))


@query("SELECT doc_id, length(text)::INT AS characters, strlen(text)::INT AS bytes, CASE WHEN length(text) <> 0 THEN round(strlen(text) / length(text), 9) END AS bytes_per_character FROM documents")
def text_lengths(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.length(t).alias("characters"), F.octet_length(t).alias("bytes"), F.round(T.ratio(F.octet_length(t), F.length(t)), 9).alias("bytes_per_character"))


@query(f"WITH {judged_sql(tokens=False)} SELECT source_ord, id, reason, length(text)::INT AS characters, text_sha256, quality_score FROM judged")
def clean_reason(spark: SparkSession, d: str) -> DataFrame:
    return C.judged(raw(spark, d), C.CleanConfig(check_tokens=False)).select("source_ord", "id", "reason", F.length("text").alias("characters"), "text_sha256", "quality_score")


@query(f"WITH {judged_sql()} SELECT source_ord, reason, provided_token_count FROM judged")
def clean_reason_tokens(spark: SparkSession, d: str) -> DataFrame:
    return C.judged(raw(spark, d), C.CleanConfig()).select("source_ord", "reason", "provided_token_count")


@query(f"WITH {corpus_sql()} SELECT dom.reason, count(c.source_ord) AS records FROM {REASON_DOMAIN} LEFT JOIN corpus c ON coalesce(c.reason, 'kept') = dom.reason GROUP BY 1")
def removal_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.removal_totals(C.judged(raw(spark, d), C.CleanConfig()))


@query(f"WITH {corpus_sql()} SELECT count(*) AS input, count(*) FILTER (WHERE reason IS NULL) AS kept, CASE WHEN count(*) = 0 THEN 0.0 ELSE round(count(*) FILTER (WHERE reason IS NULL) / count(*), 8) END AS retention_rate FROM corpus")
def retention_rate(spark: SparkSession, d: str) -> DataFrame:
    return C.retained(C.removal_totals(C.judged(raw(spark, d), C.CleanConfig())))


@query(f"WITH {corpus_sql()} SELECT source_ord, text_sha256, reason FROM corpus WHERE reason IS NULL OR reason = 'exact_duplicate'")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return C.corpus(raw(spark, d), text=False).where("reason is null or reason = 'exact_duplicate'").select("source_ord", "text_sha256", "reason")


@query(f"WITH {judged_sql()} SELECT source_ord, text_sha256 FROM judged WHERE reason IS NULL AND source_ord % 2 = 1 AND text_sha256 NOT IN (SELECT text_sha256 FROM judged WHERE reason IS NULL AND source_ord % 2 = 0)")
def dedup_against_committed(spark: SparkSession, d: str) -> DataFrame:
    """Odd ordinals are new, even ones committed: the two sides of the anti join, over all rows."""
    j = C.judged(raw(spark, d), C.CleanConfig()).where("reason is null")
    return C.not_committed(j.where("source_ord % 2 = 1"), j.where("source_ord % 2 = 0")).select("source_ord", "text_sha256")


@query(f"WITH {corpus_sql(0.8, 0.1)} SELECT source_ord, round({fraction_sql(42, 'text_sha256')}, 12) AS fraction, split FROM corpus WHERE reason IS NULL")
def split_assign(spark: SparkSession, d: str) -> DataFrame:
    return C.corpus(raw(spark, d), WIDE, text=False).where("reason is null").select("source_ord", F.round(T.fraction(42, F.col("text_sha256")), 12).alias("fraction"), "split")


@query(f"WITH {corpus_sql()} SELECT dom.split, count(c.source_ord) AS records, coalesce(sum(provided_token_count), 0)::BIGINT AS tokens, coalesce(sum(length(text)), 0)::BIGINT AS characters FROM {SPLIT_DOMAIN} LEFT JOIN corpus c ON c.split = dom.split GROUP BY 1")
def split_totals(spark: SparkSession, d: str) -> DataFrame:
    cfg = C.CleanConfig()
    return C.split_totals(C.kept_records(C.judged(raw(spark, d), cfg), cfg))


@query("SELECT text_sha256, count(DISTINCT split) AS splits FROM (SELECT sha256(text) AS text_sha256, split FROM clean_records) GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_disjoint(spark: SparkSession, d: str) -> DataFrame:
    rows = clean(spark, d).select(F.sha2("text", 256).alias("text_sha256"), "split", F.lit(None).cast("string").alias("reason"))
    return C.split_overlap(rows)


@query(f"WITH {corpus_sql()}, k AS (SELECT source_ord, provided_token_count, coalesce(sum(provided_token_count) OVER (ORDER BY source_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS tokens_before FROM corpus WHERE reason IS NULL) SELECT * FROM k WHERE tokens_before < 100000")
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    cfg = C.CleanConfig()
    kept = written(C.kept_records(C.judged(raw(spark, d), cfg), cfg).select("source_ord", "provided_token_count"), "kept")
    return ordered.budget_prefix(kept, "provided_token_count", "source_ord", 100_000)


_FOLD = """, w AS (SELECT source_ord, CASE WHEN reason IS NULL THEN provided_token_count ELSE 0 END AS n, row_number() OVER (ORDER BY source_ord) AS i FROM corpus),
fold(i, source_ord, n, shard_index, total, closed) AS (SELECT i, source_ord, n, 0, n, n >= 20000 FROM w WHERE i = 1
 UNION ALL SELECT w.i, w.source_ord, w.n, CASE WHEN fold.closed THEN fold.shard_index + 1 ELSE fold.shard_index END, CASE WHEN fold.closed THEN w.n ELSE fold.total + w.n END, CASE WHEN fold.closed THEN w.n ELSE fold.total + w.n END >= 20000
 FROM fold JOIN w ON w.i = fold.i + 1)"""
_REC = corpus_sql()


@query(f"WITH RECURSIVE {_REC}{_FOLD} SELECT source_ord, n AS packed_tokens, shard_index FROM fold")
def shard_pack_corpus(spark: SparkSession, d: str) -> DataFrame:
    return C.sharded(written(C.corpus(raw(spark, d), text=False), "corpus"), 20_000).select("source_ord", "packed_tokens", "shard_index")


@query(f"""WITH RECURSIVE {_REC}{_FOLD}, s AS (SELECT c.*, f.shard_index FROM corpus c JOIN fold f USING (source_ord)),
g AS (SELECT shard_index, reason, count(*) AS n FROM s WHERE reason IS NOT NULL GROUP BY 1, 2), gone AS (SELECT shard_index, string_agg(reason || '=' || n, ',' ORDER BY reason) AS removed FROM g GROUP BY 1)
SELECT s.shard_index, min(source_ord) AS source_start, max(source_ord) + 1 AS source_end, count(*) AS source_records, count(*) FILTER (WHERE reason IS NULL) AS kept_records,
 sum(CASE WHEN reason IS NULL THEN provided_token_count ELSE 0 END)::BIGINT AS provided_tokens, coalesce(any_value(removed), '') AS removed FROM s LEFT JOIN gone ON gone.shard_index = s.shard_index GROUP BY 1""")
def shard_metadata(spark: SparkSession, d: str) -> DataFrame:
    return C.shard_metadata(C.sharded(written(C.corpus(raw(spark, d), text=False), "corpus"), 20_000))


@query(f"""WITH RECURSIVE {_REC}{_FOLD}, m AS (SELECT shard_index, min(source_ord) AS a, max(source_ord) + 1 AS b FROM fold GROUP BY 1)
SELECT shard_index, a AS source_start, b AS source_end, coalesce(a = lag(b) OVER (ORDER BY shard_index), true) AS contiguous, row_number() OVER (ORDER BY shard_index) - 1 = shard_index AS in_sequence FROM m""")
def shard_contiguity(spark: SparkSession, d: str) -> DataFrame:
    m = C.shard_metadata(C.sharded(written(C.corpus(raw(spark, d), text=False), "corpus"), 20_000))
    return C.contiguity(written(m, "shards"))


@query(f"WITH {corpus_sql()}, a AS (SELECT count(*) AS input, count(*) FILTER (WHERE reason IS NULL) AS kept, count(reason) AS removed, count(split) AS in_splits FROM corpus) SELECT *, input = kept + removed AS rows_conserved, kept = in_splits AS splits_conserved FROM a")
def conservation_corpus(spark: SparkSession, d: str) -> DataFrame:
    return C.conservation(C.corpus(raw(spark, d), text=False))


@query("SELECT record_no, row_number() OVER (PARTITION BY split ORDER BY shard_index, line_number) - 1 AS ordinal, text_sha256 = sha256(text) AS digest_matches FROM clean_records")
def record_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Cursor of each split: ordinal over shard and line, and whether the stored digest is that of the text."""
    c = clean(spark, d).withColumn("one", F.lit(1))
    c = c.withColumn("place", F.col("shard_index").cast("bigint") * 1_000_000_000 + F.col("line_number"))
    shards = c.groupBy("split", "shard_index").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("split").orderBy("shard_index").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = Window.partitionBy("split", "shard_index").orderBy("line_number")
    d2 = c.withColumn("_r", F.row_number().over(inner)).join(base, ["split", "shard_index"])
    return d2.select("record_no", (F.col("_base") + F.col("_r") - 1).alias("ordinal"), (F.col("text_sha256") == F.sha2("text", 256)).alias("digest_matches"))


@query("SELECT source_ord, id FROM source_records WHERE source_ord > 100 ORDER BY source_ord LIMIT 250")
def source_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of the source: rows after a committed ordinal, so many of them (the page size is the feature)."""
    return raw(spark, d).where("source_ord > 100").orderBy("source_ord").limit(250).select("source_ord", "id")


@query("""SELECT record_no, CASE WHEN id IS NULL OR trim(id) = '' THEN 'no_id' WHEN provided_token_count IS NULL OR provided_token_count <= 0 THEN 'no_tokens'
 WHEN text_sha256 IS NULL OR NOT regexp_matches(text_sha256, '^[0-9a-f]{64}$') THEN 'bad_digest' WHEN text_sha256 <> sha256(text) THEN 'other_digest' END AS violation FROM clean_records""")
def record_identity_check(spark: SparkSession, d: str) -> DataFrame:
    s, n = F.col("text_sha256"), F.col("provided_token_count")
    why = F.when(F.col("id").isNull() | (F.trim("id") == ""), "no_id").when(n.isNull() | (n <= 0), "no_tokens").when(s.isNull() | ~s.rlike("^[0-9a-f]{64}$"), "bad_digest").when(s != F.sha2("text", 256), "other_digest")
    return clean(spark, d).select("record_no", why.alias("violation"))


@query("""WITH a AS (SELECT split, count(*) AS records, sum(line_number) AS lines FROM clean_records GROUP BY 1), b AS (SELECT split, count(DISTINCT (shard_index, doc_ord)) AS indexed FROM doc_index GROUP BY 1)
SELECT coalesce(a.split, b.split) AS split, records, indexed, records IS DISTINCT FROM indexed AS differs FROM a FULL JOIN b ON a.split = b.split""")
def split_count_reconcile(spark: SparkSession, d: str) -> DataFrame:
    a = clean(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("records"))
    b = table(spark, d, "doc_index").groupBy("split").agg(F.count_distinct("shard_index", "doc_ord").alias("indexed"))
    return a.join(b, "split", "full").select("split", "records", "indexed", (~F.col("records").eqNullSafe(F.col("indexed"))).alias("differs"))


@query("""WITH s AS (SELECT id, any_value(url ORDER BY source_ord) AS url, any_value(language ORDER BY source_ord) AS language FROM source_records WHERE id IS NOT NULL GROUP BY 1),
f AS (SELECT c.record_no, unnest([{'field': 'url', 'differs': c.url IS DISTINCT FROM s.url}, {'field': 'language', 'differs': c.language IS DISTINCT FROM s.language}]) AS x FROM clean_records c JOIN (SELECT id, min(source_ord) AS o FROM source_records WHERE id IS NOT NULL GROUP BY 1) m USING (id) JOIN source_records s ON s.source_ord = m.o)
SELECT x.field AS field, count(*) AS compared, count(*) FILTER (WHERE x.differs) AS differing FROM f GROUP BY 1""")
def identity_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Clean records against the first delivery of the same id, field by field."""
    s = raw(spark, d).where("id is not null")
    first = s.groupBy("id").agg(F.min_by(F.struct("url", "language"), "source_ord").alias("s"))
    j = clean(spark, d).join(first, "id")
    diff = lambda c: (~F.col(c).eqNullSafe(F.col("s")[c])).cast("int")
    a = j.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(diff("url")), F.lit(0)).alias("url"), F.coalesce(F.sum(diff("language")), F.lit(0)).alias("language"))
    return a.unpivot(["n"], ["url", "language"], "field", "differing").select("field", F.col("n").alias("compared"), "differing")


@query("""WITH p AS (SELECT source_ord, file_path FROM source_records), d AS (SELECT file_path, count(*) AS rows, min(source_ord) AS first_ord FROM p GROUP BY 1)
SELECT file_path, rows, first_ord, regexp_matches(file_path, '\\.parquet$') AND NOT starts_with(file_path, '/') AND NOT regexp_matches(file_path, '(^|/)\\.\\.?(/|$)') AND NOT contains(file_path, '//') AS valid FROM d""")
def source_path_check(spark: SparkSession, d: str) -> DataFrame:
    """Paths must be relative, normal, and end in .parquet; one row a path, so repetitions show as rows."""
    p = F.col("file_path")
    ok = p.rlike("\\.parquet$") & ~p.startswith("/") & ~p.rlike("(^|/)\\.\\.?(/|$)") & ~p.contains("//")
    return table(spark, d, "source_records").groupBy("file_path").agg(F.count(F.lit(1)).alias("rows"), F.min("source_ord").alias("first_ord")).withColumn("valid", ok)


@query("""SELECT source_ord, CASE WHEN source_ord % 3 = 0 THEN language WHEN source_ord % 3 = 1 THEN NULL ELSE language END AS language FROM source_records""")
def nested_field_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The key may be at the top (also as a null, which then counts) or under metadata; here it lies by ordinal in each of the three ways."""
    r = raw(spark, d).withColumn("metadata", F.struct("language"))
    r = r.withColumn("present", F.col("source_ord") % 3 != 2).withColumn("flat", F.when(F.col("source_ord") % 3 == 0, F.col("language")))
    return r.select("source_ord", C.nested_or_flat("language", F.col("present"), F.col("metadata.language"), F.col("flat")))


_CAST = "CASE source_ord % 5 WHEN 0 THEN ' ' || language_score || ' ' WHEN 1 THEN language_score::VARCHAR WHEN 2 THEN language WHEN 3 THEN '' ELSE NULL END"


@query(f"SELECT source_ord, round(try_cast(trim({_CAST.replace('language_score', 'int_score')}) AS DOUBLE), 6) AS value FROM source_records")
def lenient_numeric_cast(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("int_score").cast("string")
    v = F.when(F.col("source_ord") % 5 == 0, F.concat(F.lit(" "), s, F.lit(" "))).when(F.col("source_ord") % 5 == 1, s).when(F.col("source_ord") % 5 == 2, F.col("language")).when(F.col("source_ord") % 5 == 3, F.lit(""))
    return raw(spark, d).select("source_ord", F.round(T.lenient_double(v), 6).alias("value"))


@query("SELECT doc_id, right(text, 4000) AS tail FROM documents")
def tail_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.expr("right(text, 4000)").alias("tail"))


@query("""WITH c AS (SELECT unnest(['id','text','url','language','language_score','quality_score','provided_token_count','text_sha256']) AS k), s AS (SELECT unnest(['id','text','url','language','language_score','int_score','token_count']) AS k)
SELECT coalesce(c.k, s.k) AS key, CASE WHEN s.k IS NULL THEN 'unexpected' ELSE 'missing' END AS state FROM c FULL JOIN s ON c.k = s.k WHERE c.k IS NULL OR s.k IS NULL""")
def key_set_diff(spark: SparkSession, d: str) -> DataFrame:
    """Columns of the clean schema against the source projection's, as sets."""
    want = ["id", "text", "url", "language", "language_score", "int_score", "token_count"]
    have = [c for c in clean(spark, d).columns if c not in ("record_no", "split", "shard_index", "line_number")]
    a = F.array(*[F.lit(x) for x in have])
    b = F.array(*[F.lit(x) for x in want])
    one = spark.range(1)
    return one.select(F.explode(F.array_except(a, b)).alias("key"), F.lit("unexpected").alias("state")).union(one.select(F.explode(F.array_except(b, a)), F.lit("missing")))


@query("""WITH j AS (SELECT event_id, props, TRY_CAST(props AS JSON) AS v FROM events) SELECT event_id, CASE WHEN props IS NULL OR trim(props) = '' THEN 'blank' WHEN NOT json_valid(props) THEN 'not_json' WHEN json_type(v) <> 'OBJECT' THEN 'not_object' END AS violation FROM j""")
def json_record_check(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are blank, no JSON, or no object."""
    p = F.col("props")
    v = F.try_parse_json(p)
    kind = F.schema_of_variant(v)
    why = F.when(p.isNull() | (F.trim(p) == ""), "blank").when(v.isNull(), "not_json").when(~kind.startswith("OBJECT"), "not_object")
    return table(spark, d, "events").select("event_id", why.alias("violation"))
