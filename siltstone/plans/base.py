"""Registration of queries and the SQL fragments that their twins share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


RAW_COLUMNS = ["source_ord", "id", "text", "url", "language", "language_score", "int_score", "token_count"]


def raw(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "source_records").select(*RAW_COLUMNS))


def clean(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "clean_records"))


_WS = r"\t\x0B\f\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def norm_sql(c: str) -> str:
    x = f"regexp_replace(nfc_normalize({c}), '\\r\\n?', chr(10), 'g')"
    x = f"regexp_replace({x}, '[{_WS}]+', ' ', 'g')"
    x = f"regexp_replace({x}, ' ?\\n ?', chr(10), 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({x}, '^[ \\n]+|[ \\n]+$', '', 'g')"


VISIBLE = f"coalesce(regexp_matches(text, '[^\\n\\r{_WS}]'), false)"


def fraction_sql(seed, value: str) -> str:
    return f"(('0x' || substr(sha256('{seed}:' || {value}), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551616.0"


def judged_sql(tokens: bool = True) -> str:
    bad = "WHEN token_count IS NULL OR token_count <= 0 THEN 'missing_or_invalid_provided_token_count'" if tokens else ""
    return f"""normed AS (SELECT *, {norm_sql("text")} AS t FROM source_records),
judged AS (SELECT source_ord, id, t AS text, url, language, language_score, int_score::INT AS quality_score, token_count AS provided_token_count, sha256(t) AS text_sha256,
  CASE WHEN NOT {VISIBLE} THEN 'missing_or_empty_text' WHEN length(t) < 200 THEN 'short_text' WHEN language IS DISTINCT FROM 'en' THEN 'non_english'
  WHEN language_score IS NULL OR language_score < 0.65 THEN 'low_or_missing_language_score' WHEN int_score IS NULL OR int_score < 3 THEN 'low_or_missing_quality_score' {bad} END AS reason FROM normed)"""


def corpus_sql(train: float = 0.98, validation: float = 0.01) -> str:
    u = fraction_sql(42, "text_sha256")
    return f"""{judged_sql()},
ranked AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY text_sha256, reason ORDER BY source_ord) END AS rn FROM judged),
marked AS (SELECT * EXCLUDE (reason, rn), CASE WHEN rn > 1 THEN 'exact_duplicate' ELSE reason END AS reason FROM ranked),
corpus AS (SELECT *, CASE WHEN reason IS NULL THEN CASE WHEN {u} < {train!r} THEN 'train' WHEN {u} < {train + validation!r} THEN 'validation' ELSE 'test' END END AS split FROM marked)"""


TOKENS_SQL = """tokenized AS (SELECT record_no, split, shard_index, line_number - 1 AS doc_ord, sha256(text) AS text_sha256, provided_token_count AS provided_tokens, length(text) AS characters, strlen(text) AS bytes,
  list_concat(list_transform(CASE WHEN text = '' THEN []::VARCHAR[] ELSE regexp_extract_all(text, '(?s).') END, lambda c: (100 + unicode(c) % 97)::INT), [1]) AS tokens FROM clean_records WHERE text IS NOT NULL AND split IS NOT NULL),
docs AS (SELECT *, len(tokens)::INT AS n_tokens FROM tokenized)"""

STREAM_SQL = f"""{TOKENS_SQL},
placed AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY split, shard_index ORDER BY doc_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_token,
  coalesce(sum(n_tokens) OVER (PARTITION BY split ORDER BY shard_index, doc_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS global_start FROM docs)"""
