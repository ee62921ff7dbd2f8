"""Queries that validate corpora, token streams and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import tokens as K
from ..operators import validate as V
from ..session import written
from .base import STREAM_SQL, TOKENS_SQL, clean, corpus_sql, query, raw, table

_FILES = """files AS (SELECT printf('shards/shard-%05d/%s.jsonl', shard_index, split) AS path, shard_index, split, count(*) AS records, coalesce(sum(provided_token_count), 0)::BIGINT AS provided_tokens, sum(coalesce(strlen(text), 0) + 1)::BIGINT AS bytes,
 sha256(string_agg(coalesce(sha256(text), ''), '' ORDER BY line_number)) AS sha256 FROM clean_records WHERE shard_index IS NOT NULL AND split IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {_FILES} SELECT * FROM files")
def shard_files(spark: SparkSession, d: str) -> DataFrame:
    return V.shard_files(clean(spark, d))


@query(f"""WITH {_FILES}, once AS (SELECT DISTINCT split, shard_index, doc_ord, text_sha256 FROM doc_index), found AS (SELECT printf('shards/shard-%05d/%s.jsonl', shard_index, split) AS path, count(*) AS records, sha256(string_agg(lower(hex(text_sha256)), '' ORDER BY doc_ord, lower(hex(text_sha256)))) AS sha256 FROM once GROUP BY 1),
j AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'extra' WHEN a.records <> b.records THEN 'size' WHEN a.sha256 <> b.sha256 THEN 'digest' END AS state FROM files a FULL JOIN found b ON a.path = b.path) SELECT * FROM j WHERE state IS NOT NULL""")
def file_set_diff(spark: SparkSession, d: str) -> DataFrame:
    """Registered files (of the records) against found ones (of the index): names, sizes and digests, both ways."""
    once = table(spark, d, "doc_index").select("split", "shard_index", "doc_ord", F.lower(F.hex("text_sha256")).alias("h")).distinct()
    entries = F.transform(F.array_sort(F.collect_list(F.struct("doc_ord", "h"))), lambda x: x["h"])
    found = once.groupBy(F.format_string("shards/shard-%05d/%s.jsonl", "shard_index", "split").alias("path")).agg(F.count(F.lit(1)).alias("records"), F.sha2(F.array_join(entries, ""), 256).alias("sha256"))
    return V.file_differences(V.shard_files(clean(spark, d)), found)


_FOLD = """, w AS (SELECT source_ord, CASE WHEN reason IS NULL THEN provided_token_count ELSE 0 END AS n, row_number() OVER (ORDER BY source_ord) AS i FROM corpus),
fold(i, source_ord, n, shard_index, total, closed) AS (SELECT i, source_ord, n, 0, n, n >= 20000 FROM w WHERE i = 1
 UNION ALL SELECT w.i, w.source_ord, w.n, CASE WHEN fold.closed THEN fold.shard_index + 1 ELSE fold.shard_index END, CASE WHEN fold.closed THEN w.n ELSE fold.total + w.n END, CASE WHEN fold.closed THEN w.n ELSE fold.total + w.n END >= 20000 FROM fold JOIN w ON w.i = fold.i + 1)"""


@query(f"""WITH RECURSIVE {corpus_sql()}{_FOLD}, s AS (SELECT f.shard_index, min(c.source_ord) AS a, max(c.source_ord) + 1 AS b, count(*) AS n, count(*) FILTER (WHERE reason IS NULL) AS kept, count(reason) AS removed, sum(CASE WHEN reason IS NULL THEN provided_token_count ELSE 0 END) AS tokens FROM corpus c JOIN fold f USING (source_ord) GROUP BY 1),
x AS (SELECT *, row_number() OVER (ORDER BY shard_index) - 1 AS i, coalesce(lag(b) OVER (ORDER BY shard_index), a) AS before FROM s), p AS (SELECT split, count(*) AS records, sum(provided_token_count) AS tokens FROM corpus WHERE reason IS NULL GROUP BY 1),
q AS (SELECT dom.split, coalesce(records, 0) AS records, coalesce(tokens, 0) AS tokens FROM (VALUES ('train'), ('validation'), ('test')) dom(split) LEFT JOIN p ON p.split = dom.split)
SELECT 'contiguous_indexes' AS rule, count(*) AS checked, count(*) FILTER (WHERE shard_index <> i) AS failed FROM x UNION ALL SELECT 'contiguous_ranges', count(*), count(*) FILTER (WHERE a <> before) FROM x UNION ALL SELECT 'range_not_empty', count(*), count(*) FILTER (WHERE b <= a) FROM x
UNION ALL SELECT 'records_conserved', count(*), count(*) FILTER (WHERE n <> kept + removed) FROM x UNION ALL SELECT 'split_not_empty', count(*), count(*) FILTER (WHERE records = 0) FROM q
UNION ALL SELECT 'shards_add_up_to_splits', 1, ((SELECT sum(kept) FROM s) <> (SELECT sum(records) FROM q) OR (SELECT sum(tokens) FROM s) <> (SELECT sum(tokens) FROM q))::INT UNION ALL SELECT 'target_reached', 1, ((SELECT sum(tokens) FROM s) < 1000000000)::INT""")
def manifest_check(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of a corpus built from the raw records; its token target (a billion) is beyond the test tables."""
    rows = written(C.corpus(raw(spark, d), text=False), "corpus")
    s = C.sharded(rows, 20_000)
    kept = F.col("reason").isNull()
    shards = s.groupBy("shard_index").agg(
        F.min("source_ord").alias("source_start"), (F.max("source_ord") + 1).alias("source_end"), F.count(F.lit(1)).alias("source_records"), F.count_if(kept).alias("kept_records"), F.count("reason").alias("removed_records"),
        F.sum(F.when(kept, F.col("provided_token_count")).otherwise(F.lit(0))).alias("provided_tokens"),
    )
    return V.manifest_rules(written(shards, "shards"), C.split_totals(rows), 1_000_000_000)


@query(f"""WITH {STREAM_SQL}, s AS (SELECT split, shard_index, count(*) AS n, sum(n_tokens) AS t, min(global_start) AS ts, count(*) FILTER (WHERE tokens[-1] = 1) AS ends, min(list_min(tokens)) AS lo, max(list_max(tokens)) AS hi FROM placed GROUP BY 1, 2),
x AS (SELECT *, row_number() OVER o - 1 AS i, coalesce(sum(t) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s WINDOW o AS (PARTITION BY split ORDER BY shard_index))
SELECT 'contiguous_shards' AS rule, count(*) AS checked, count(*) FILTER (WHERE shard_index <> i) AS failed FROM x UNION ALL SELECT 'token_prefix', count(*), count(*) FILTER (WHERE ts <> before) FROM x UNION ALL SELECT 'document_prefix', count(*), 0 FROM x
UNION ALL SELECT 'an_end_per_document', count(*), count(*) FILTER (WHERE ends <> n) FROM x UNION ALL SELECT 'least_within_greatest', count(*), count(*) FILTER (WHERE lo < 0 OR lo > hi) FROM x UNION ALL SELECT 'not_empty', count(*), count(*) FILTER (WHERE n = 0 OR t < 2 * n) FROM x""")
def token_corpus_check(spark: SparkSession, d: str) -> DataFrame:
    """Whole-corpus rules over the token shards of every split."""
    docs = K.token_documents(clean(spark, d)).select("split", "shard_index", "doc_ord", "n_tokens", F.element_at("tokens", -1).alias("last"), F.array_min("tokens").alias("lo"), F.array_max("tokens").alias("hi"))
    st = K.offsets(docs)
    shards = st.groupBy("split", "shard_index").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"), F.min("global_start").alias("token_start"), F.count_if(F.col("last") == 1).alias("ends"), F.min("lo").alias("least"), F.max("hi").alias("greatest")
    )
    shards = written(shards, "shards")
    return V.stream_rules(K.document_starts(shards))


_HEADERS = "h AS (SELECT split, shard_index, count(*) AS documents, sum(length_tokens)::BIGINT AS tokens FROM doc_index GROUP BY 1, 2)"


@query(f"""WITH {TOKENS_SQL}, s AS (SELECT split, shard_index, count(*) AS documents, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY 1, 2), {_HEADERS}, j AS (SELECT coalesce(s.split, h.split) AS split, coalesce(s.shard_index, h.shard_index) AS shard_index,
 unnest([{{'field': 'documents', 'actual': s.documents, 'stated': h.documents}}, {{'field': 'tokens', 'actual': s.tokens, 'stated': h.tokens}}]) AS x FROM s FULL JOIN h ON s.split = h.split AND s.shard_index = h.shard_index)
SELECT split, shard_index, x.field AS field, x.actual AS actual, x.stated AS stated FROM j WHERE x.actual IS DISTINCT FROM x.stated""")
def shard_header_check(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of each shard's documents against what its index states."""
    s = K.token_documents(clean(spark, d)).groupBy("split", "shard_index").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"))
    return V.header_differences(s, _headers(spark, d), ["split", "shard_index"], ["documents", "tokens"])


def _headers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_index").groupBy("split", "shard_index").agg(F.count(F.lit(1)).alias("documents"), F.sum("length_tokens").alias("tokens"))


@query(f"""WITH {TOKENS_SQL}, {_HEADERS}, a AS (SELECT split, shard_index, count(*) AS documents, sum(n_tokens)::BIGINT AS tokens, grouping(split, shard_index) AS g FROM docs GROUP BY ROLLUP (split, shard_index)), b AS (SELECT split, shard_index, sum(documents)::BIGINT AS stated_documents, sum(tokens)::BIGINT AS stated_tokens, grouping(split, shard_index) AS g FROM h GROUP BY ROLLUP (split, shard_index))
SELECT CASE coalesce(a.g, b.g) WHEN 0 THEN 'shard' WHEN 1 THEN 'split' ELSE 'total' END AS level, coalesce(a.split, b.split) AS split, coalesce(a.shard_index, b.shard_index) AS shard_index, documents, tokens, stated_documents, stated_tokens, documents IS NOT DISTINCT FROM stated_documents AND tokens IS NOT DISTINCT FROM stated_tokens AS equal
FROM a FULL JOIN b ON a.g = b.g AND a.split IS NOT DISTINCT FROM b.split AND a.shard_index IS NOT DISTINCT FROM b.shard_index""")
def shard_sum_check(spark: SparkSession, d: str) -> DataFrame:
    """Shard, split and total sums of the documents against those of the index."""
    return K.shard_equalities(K.token_documents(clean(spark, d)).select("split", "shard_index", "n_tokens"), _headers(spark, d))


@query(f"""WITH {STREAM_SQL}, i AS (SELECT split, shard_index, doc_ord, start_token, length_tokens, start_token + length_tokens - 1 AS position FROM doc_index)
SELECT i.split, i.shard_index, i.doc_ord, i.start_token, i.length_tokens, p.tokens[position - p.start_token + 1] AS token, coalesce(p.tokens[position - p.start_token + 1] = 1, false) AS ends FROM i LEFT JOIN placed p ON p.split = i.split AND p.shard_index = i.shard_index AND position >= p.start_token AND position < p.start_token + p.n_tokens""")
def index_end_check(spark: SparkSession, d: str) -> DataFrame:
    """Index entries with the token at their last place in the shard's stream, which must be the end id."""
    docs = K.offsets(K.token_documents(clean(spark, d)).select("split", "shard_index", "doc_ord", "n_tokens", "tokens"))
    return V.end_tokens(table(spark, d, "doc_index"), docs)


@query("""WITH t AS (SELECT record_no, split, shard_index, line_number, id, provided_token_count, text, text_sha256, count(*) OVER (PARTITION BY id) AS ids, count(*) OVER (PARTITION BY split, shard_index, line_number) AS places FROM clean_records)
SELECT rule, count(*) AS checked, count(*) FILTER (WHERE NOT coalesce(ok, false)) AS failed FROM (SELECT unnest([{'rule': 'text', 'ok': text IS NOT NULL AND text <> ''}, {'rule': 'digest', 'ok': text_sha256 = sha256(text)}, {'rule': 'unique_id', 'ok': id IS NOT NULL AND ids = 1}, {'rule': 'tokens', 'ok': provided_token_count > 0},
 {'rule': 'split', 'ok': split IN ('train', 'validation', 'test')}, {'rule': 'unique_place', 'ok': places = 1}]) AS x FROM t), LATERAL (SELECT x.rule AS rule, x.ok AS ok) GROUP BY 1""")
def completed_split_check(spark: SparkSession, d: str) -> DataFrame:
    """Rules of completed split files, record by record: text, digest, unique id, tokens, split, unique place."""
    c = clean(spark, d)
    ids, places = c.groupBy("id").agg(F.count(F.lit(1)).alias("_ids")), c.groupBy("split", "shard_index", "line_number").agg(F.count(F.lit(1)).alias("_places"))
    j = c.join(ids, "id", "left").join(places, ["split", "shard_index", "line_number"], "left")
    return V.rules(
        j,
        {
            "text": F.col("text") != "", "digest": F.col("text_sha256") == F.sha2("text", 256), "unique_id": F.col("_ids") == 1, "tokens": F.col("provided_token_count") > 0,
            "split": F.col("split").isin("train", "validation", "test"), "unique_place": F.col("_places") == 1,
        },
    )
