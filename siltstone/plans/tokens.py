"""Queries over token documents, the index and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import generation as G
from ..operators import tokens as K
from ..operators import windows as W
from ..operators.ordered import pack_close_before
from .base import STREAM_SQL, TOKENS_SQL, clean, query, table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return K.token_documents(clean(spark, d))


def _stream(spark: SparkSession, d: str, tokens: bool = True) -> DataFrame:
    docs = _docs(spark, d).select("record_no", "split", "shard_index", "doc_ord", "n_tokens", *["tokens"] * tokens)
    return K.offsets(docs)


def _ids_sql(c: str) -> str:
    return f"sha256('[' || array_to_string({c}, ',') || ']')"


@query(f"WITH {TOKENS_SQL} SELECT record_no, n_tokens, {_ids_sql('tokens')} AS ids_sha256 FROM docs")
def token_encode_dummy(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("record_no", "n_tokens", T.ids_digest(F.col("tokens")).alias("ids_sha256"))


@query(f"""WITH {TOKENS_SQL} SELECT CASE WHEN n_tokens < 2 THEN 'too_short' WHEN tokens[-1] <> 1 THEN 'no_end' WHEN list_min(tokens) < 0 OR list_max(tokens) >= 16384 THEN 'out_of_range' WHEN list_contains(tokens, 3) THEN 'unknown_id' ELSE 'ok' END AS violation, count(*) AS documents FROM docs GROUP BY 1""")
def token_document_checks(spark: SparkSession, d: str) -> DataFrame:
    return K.document_checks(_docs(spark, d)).groupBy(F.coalesce("violation", F.lit("ok")).alias("violation")).agg(F.count(F.lit(1)).alias("documents"))


_STATS = """count(*) AS records, sum(characters)::BIGINT AS characters, sum(bytes)::BIGINT AS utf8_bytes, sum(n_tokens)::BIGINT AS tokens, sum(provided_tokens)::BIGINT AS provided, min(list_min(tokens)) AS min_id, max(list_max(tokens)) AS max_id,
 avg(n_tokens) AS mean_length, quantile_cont(n_tokens, 0.5) AS p50, quantile_cont(n_tokens, 0.95) AS p95, quantile_cont(n_tokens, 0.99) AS p99, count(*) FILTER (WHERE n_tokens > 512) AS over_context"""
_RATIOS = "characters / tokens AS characters_per_token, utf8_bytes / tokens AS bytes_per_token, tokens / provided AS model_per_provided, over_context / records AS over_context_ratio"


@query(f"WITH {TOKENS_SQL}, a AS (SELECT split, {_STATS} FROM docs GROUP BY 1) SELECT *, {_RATIOS} FROM a")
def token_split_stats(spark: SparkSession, d: str) -> DataFrame:
    return K.split_statistics(_docs(spark, d))


@query(f"WITH {TOKENS_SQL}, a AS (SELECT {_STATS} FROM docs) SELECT *, {_RATIOS} FROM a")
def token_total_stats(spark: SparkSession, d: str) -> DataFrame:
    return K.split_statistics(_docs(spark, d), by=[])


@query(f"WITH {TOKENS_SQL} SELECT split, " + ", ".join(f"sum(len(list_filter(tokens, lambda t: t = {i})))::BIGINT AS {k}" for k, i in K.SPECIALS.items()) + " FROM docs GROUP BY 1")
def token_special_hist(spark: SparkSession, d: str) -> DataFrame:
    return K.special_counts(_docs(spark, d))


@query(f"WITH {TOKENS_SQL} SELECT split, shard_index, count(*) AS records, sum(n_tokens)::BIGINT AS model_tokens, sum(n_tokens - 1)::BIGINT AS raw_tokens, count(*) FILTER (WHERE tokens[-1] = 1) AS end_tokens, min(list_min(tokens)) AS min_id, max(list_max(tokens)) AS max_id FROM docs GROUP BY ROLLUP (split, shard_index)")
def token_statistics_rollup(spark: SparkSession, d: str) -> DataFrame:
    return K.statistics_rollup(_docs(spark, d))


@query(f"""WITH RECURSIVE {TOKENS_SQL}, o AS (SELECT split, n_tokens::BIGINT AS n, shard_index * 1000000000 + doc_ord AS place, row_number() OVER (PARTITION BY split ORDER BY shard_index, doc_ord) AS i FROM docs),
fold(split, i, place, n, shard, total) AS (SELECT split, i, place, n, 0, n FROM o WHERE i = 1 UNION ALL
 SELECT o.split, o.i, o.place, o.n, CASE WHEN f.total > 0 AND f.total + o.n > 20000 THEN f.shard + 1 ELSE f.shard END, CASE WHEN f.total > 0 AND f.total + o.n > 20000 THEN o.n ELSE f.total + o.n END FROM fold f JOIN o ON o.split = f.split AND o.i = f.i + 1)
SELECT split, place, n AS n_tokens, shard AS shard_index FROM fold""")
def token_shard_pack(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select("split", (F.col("shard_index").cast("bigint") * 1_000_000_000 + F.col("doc_ord")).alias("place"), "n_tokens")
    return pack_close_before(docs, "n_tokens", "place", 20_000)


@query(f"WITH {STREAM_SQL} SELECT record_no, start_token, global_start FROM placed")
def token_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _stream(spark, d, tokens=False).select("record_no", "start_token", "global_start")


@query("""WITH w AS (SELECT *, coalesce(lag(start_token + length_tokens) OVER o, 0)::BIGINT AS expected, lag(doc_ord) OVER o AS prev FROM doc_index WINDOW o AS (PARTITION BY split, shard_index ORDER BY doc_ord, start_token, hex(text_sha256))),
v AS (SELECT *, CASE WHEN length_tokens <= 0 THEN 'zero_length' WHEN prev = doc_ord THEN 'repeated' WHEN start_token < expected THEN 'overlap' WHEN start_token > expected THEN 'gap' END AS violation FROM w)
SELECT split, shard_index, doc_ord, start_token, length_tokens, expected, violation FROM v WHERE violation IS NOT NULL""")
def index_gap_check(spark: SparkSession, d: str) -> DataFrame:
    return K.index_gaps(table(spark, d, "doc_index"))


@query("""WITH c AS (SELECT split, shard_index, line_number - 1 AS doc_ord, sha256(text) AS actual FROM clean_records), i AS (SELECT split, shard_index, doc_ord, lower(hex(text_sha256)) AS indexed FROM doc_index),
j AS (SELECT indexed, actual FROM i FULL JOIN c ON i.split = c.split AND i.shard_index = c.shard_index AND i.doc_ord = c.doc_ord)
SELECT CASE WHEN indexed IS NULL THEN 'not_indexed' WHEN actual IS NULL THEN 'no_record' WHEN indexed <> actual THEN 'other_text' ELSE 'ok' END AS violation, count(*) AS entries FROM j GROUP BY 1""")
def index_binding(spark: SparkSession, d: str) -> DataFrame:
    return K.index_binding(table(spark, d, "doc_index"), clean(spark, d))


@query(f"""WITH {TOKENS_SQL}, a AS (SELECT count(*) AS records, sum(n_tokens)::BIGINT AS model, sum(n_tokens - 1)::BIGINT AS raw, sum(len(list_filter(tokens, lambda t: t = 1)))::BIGINT AS eos, sum(len(list_filter(tokens, lambda t: t IN (0, 2, 3))))::BIGINT AS others, min(list_min(tokens)) AS lo, max(list_max(tokens)) AS hi FROM docs)
SELECT records, model, raw, eos, others, records = eos AND raw + eos = model AND others = 0 AND lo <= hi AS conserved FROM a""")
def conservation_tokens(spark: SparkSession, d: str) -> DataFrame:
    return K.token_conservation(_docs(spark, d))


@query(f"""WITH {STREAM_SQL}, s AS (SELECT split, shard_index, min(global_start)::BIGINT AS start, sum(n_tokens)::BIGINT AS tokens FROM placed GROUP BY 1, 2), p AS (SELECT DISTINCT split, (start_token * 7 + 3) % (SELECT sum(n_tokens) FROM placed q WHERE q.split = placed.split)::BIGINT AS position FROM placed)
SELECT p.split, p.position, s.shard_index, p.position - s.start AS local_position FROM p JOIN s ON s.split = p.split AND p.position >= s.start AND p.position < s.start + s.tokens""")
def position_to_shard(spark: SparkSession, d: str) -> DataFrame:
    st = _stream(spark, d, tokens=False)
    shards = st.groupBy("split", "shard_index").agg(F.min("global_start").alias("start"), F.sum("n_tokens").alias("tokens"))
    p = st.select("split", ((F.col("start_token") * 7 + 3) % F.col("stream_tokens")).alias("position")).distinct()
    return K.shard_of_position(p, shards)


@query(f"""WITH {STREAM_SQL}, sz AS (SELECT split, (sum(n_tokens)::BIGINT - 1) // 512 AS nw FROM docs GROUP BY 1),
r AS (SELECT split, global_start AS s, global_start + n_tokens AS e, tokens, unnest(range(greatest(0, (global_start - 1) // 512), least(nw - 1, (global_start + n_tokens - 1) // 512) + 1)) AS k FROM placed JOIN sz USING (split)),
p AS (SELECT split, k, greatest(k * 512, s) AS a, least(k * 512 + 513, e) AS z, s, tokens FROM r), w AS (SELECT split, k, flatten(list(tokens[a - s + 1:z - s] ORDER BY a)) AS c FROM p WHERE a < z GROUP BY 1, 2)
SELECT split, k AS window_id, k * 512 AS start, {_ids_sql('c[1:512]')} AS x_sha256, {_ids_sql('c[2:513]')} AS y_sha256 FROM w""")
def windows_sequential(spark: SparkSession, d: str) -> DataFrame:
    w = W.sequential(_stream(spark, d), 512)
    return w.select("split", "window_id", "start", T.ids_digest(F.col("x")).alias("x_sha256"), T.ids_digest(F.col("y")).alias("y_sha256"))


def _starts_sql(what: str, where: str = "true") -> str:
    return f"""WITH {STREAM_SQL}, sz AS (SELECT split, sum(n_tokens)::BIGINT AS n FROM docs GROUP BY 1), q AS (SELECT split, n, unnest(range((n - 1) // 128)) AS sample_index FROM sz), st AS (SELECT split, sample_index, {what} AS start FROM q WHERE {where}),
p AS (SELECT st.split, sample_index, start, greatest(start, global_start) AS a, least(start + 129, global_start + n_tokens) AS z, global_start AS s, tokens FROM st JOIN placed f ON f.split = st.split AND f.global_start < start + 129 AND f.global_start + n_tokens > start),
g AS (SELECT split, sample_index, start, flatten(list(tokens[a - s + 1:z - s] ORDER BY a)) AS c FROM p GROUP BY 1, 2, 3)
SELECT split, sample_index, start, {_ids_sql('c[1:128]')} AS x_sha256, {_ids_sql('c[2:129]')} AS y_sha256 FROM g"""


def _samples(st: DataFrame) -> DataFrame:
    """One epoch's draws: as many a split as it has windows side by side."""
    n = st.groupBy("split").agg(F.max("stream_tokens").alias("n")).where("n > 128")
    return n.withColumn("sample_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / 128) - 1)))


def _windows(st: DataFrame, starts: DataFrame) -> DataFrame:
    w = W.at_starts(st, starts.select("split", "sample_index", "start"), 128)
    return w.select("split", "sample_index", "start", T.ids_digest(F.col("x")).alias("x_sha256"), T.ids_digest(F.col("y")).alias("y_sha256"))


@query(_starts_sql("(sample_index * 97) % (n - 128)"))
def windows_all_starts_sample(spark: SparkSession, d: str) -> DataFrame:
    """Windows of the all-starts population (every place but the last 128) at a stride of 97, around each split's stream."""
    st = _stream(spark, d)
    return _windows(st, _samples(st).withColumn("start", (F.col("sample_index") * 97) % (F.col("n") - 128)))


_DRAW = "('0x' || substr(sha256('42:3:' || sample_index), 1, 15))::BIGINT % (n - 128)"


@query(_starts_sql(_DRAW))
def windows_sampled(spark: SparkSession, d: str) -> DataFrame:
    """All draws of an epoch."""
    st = _stream(spark, d)
    return _windows(st, W.sample_starts(_samples(st), F.col("n") - 128, 42, 3))


@query(_starts_sql(_DRAW, "sample_index >= 25"))
def windows_sampled_resume(spark: SparkSession, d: str) -> DataFrame:
    """The same draw resumed after 25 samples, for which no earlier draw is needed."""
    st = _stream(spark, d)
    return _windows(st, W.sample_starts(_samples(st).where("sample_index >= 25"), F.col("n") - 128, 42, 3))


_BATCH = f"WITH {TOKENS_SQL}, w AS (SELECT split, unnest(range((sum(n_tokens)::BIGINT - 1) // 512)) AS i FROM docs GROUP BY split), b AS (SELECT split, i // 16 AS batch_id, count(*) AS samples, min(i) AS first_index, max(i) AS last_index FROM w GROUP BY 1, 2)"


def _batched(spark: SparkSession, d: str, drop: bool, first: int | None = None) -> DataFrame:
    n = W.stream_sizes(_docs(spark, d)).withColumn("w", F.floor((F.col("n") - 1) / 512)).where("w > 0")
    rows = n.select("split", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("w") - 1)).alias("i"))
    return W.batches(rows, "i", 16, drop, ["split"], first)


@query(f"{_BATCH} SELECT * FROM b WHERE samples = 16")
def batches_drop_last(spark: SparkSession, d: str) -> DataFrame:
    return _batched(spark, d, True)


@query(f"{_BATCH} SELECT * FROM b")
def batches_keep_tail(spark: SparkSession, d: str) -> DataFrame:
    return _batched(spark, d, False)


@query(f"{_BATCH} SELECT * FROM b WHERE batch_id < 3")
def batches_first(spark: SparkSession, d: str) -> DataFrame:
    """The first three batches of each split (their number is the feature)."""
    return _batched(spark, d, False, 3)


@query(f"""WITH {TOKENS_SQL}, s AS (SELECT split, sum(n_tokens)::BIGINT - 512 AS total FROM docs GROUP BY 1), c AS (SELECT split, total, unnest([0, 64, 100, total // 64 * 64, total + 64]) AS consumed FROM s)
SELECT split, consumed, greatest(total - consumed, 0) AS remaining, greatest(total - consumed, 0) // 8 AS micro_batches, greatest(total - consumed, 0) // 64 AS updates, greatest(total - consumed, 0) % 64 AS unused, consumed BETWEEN 0 AND total AND consumed % 64 = 0 AS valid FROM c""")
def stream_cursor(spark: SparkSession, d: str) -> DataFrame:
    """Places in each split's all-starts population with micro-batches of 8 and updates of 8 of them."""
    n = W.stream_sizes(_docs(spark, d)).withColumn("total", F.col("n") - 512)
    c = n.select("split", "total", F.explode(F.array(F.lit(0), F.lit(64), F.lit(100), F.floor(F.col("total") / 64) * 64, F.col("total") + 64)).alias("consumed"))
    return c.select("split", "consumed", *[v.alias(k) for k, v in W.cursor(F.col("consumed"), F.col("total"), 8, 8).items()])


@query(f"WITH {TOKENS_SQL}, s AS (SELECT split, sum(n_tokens)::BIGINT AS n FROM docs GROUP BY 1) SELECT split, n, n - 512 AS all_starts, (n - 1) // 512 AS sequential, (n - 1) % 512 AS remainder, ((n - 1) // 512) * 512 + (n - 1) % 512 = n - 1 AS conserved FROM s")
def coverage_check(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    k = F.floor((n - 1) / 512)
    return W.stream_sizes(_docs(spark, d)).select("split", "n", (n - 512).alias("all_starts"), k.alias("sequential"), ((n - 1) % 512).alias("remainder"), (k * 512 + (n - 1) % 512 == n - 1).alias("conserved"))


@query(f"WITH {TOKENS_SQL} SELECT record_no, {_ids_sql('tokens')} AS digest FROM docs")
def array_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("record_no", T.ids_digest(F.col("tokens")).alias("digest"))


@query(f"WITH {TOKENS_SQL} SELECT record_no, list_transform(range(40), lambda i: tokens[1 + i % n_tokens]) AS ids FROM docs")
def array_repeat_truncate(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("record_no", T.repeat_to(F.col("tokens"), 40).alias("ids"))


_PAIR = f"WITH {TOKENS_SQL}, p AS (SELECT a.record_no, a.tokens AS x, b.tokens AS y, least(a.n_tokens, b.n_tokens) AS m, a.n_tokens AS na, b.n_tokens AS nb FROM docs a JOIN docs b ON b.record_no = a.record_no + 1)"


def _neighbours(docs: DataFrame, value: Column) -> DataFrame:
    """value of each record as x, and of the following one as y.  The join is told not to broadcast: file sizes say little about the size of texts and id lists."""
    a = docs.select("record_no", value.alias("x"))
    b = docs.select((F.col("record_no") - 1).alias("record_no"), value.alias("y"))
    return a.join(b.hint("merge"), "record_no")


@query(f"{_PAIR} SELECT record_no, CASE WHEN list_position(list_transform(range(1, m + 1), lambda i: x[i] IS DISTINCT FROM y[i]), true) > 0 THEN list_position(list_transform(range(1, m + 1), lambda i: x[i] IS DISTINCT FROM y[i]), true) - 1 WHEN na <> nb THEN m END AS first_divergence FROM p")
def array_first_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Texts are joined, which are shorter than their id lists; both are tokenized after the join."""
    pairs = _neighbours(clean(spark, d).where("text is not null and split is not null"), F.col("text"))
    ids = pairs.select("record_no", K.code_point_ids(F.col("x")).alias("x"), K.code_point_ids(F.col("y")).alias("y"))
    return ids.select("record_no", T.first_divergence(F.col("x"), F.col("y")).alias("first_divergence"))


@query(f"{_PAIR} SELECT record_no, len(list_intersect(list_sort(list_distinct(x), 'DESC')[1:5], list_sort(list_distinct(y), 'DESC')[1:5]))::INT AS overlap FROM p")
def topk_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Each record's five highest ids are found before the join, so no id list is shuffled."""
    top = F.slice(F.sort_array(F.array_distinct("tokens"), asc=False), 1, 5)
    return _neighbours(_docs(spark, d), top).select("record_no", F.size(F.array_intersect("x", "y")).alias("overlap"))


@query(f"WITH {TOKENS_SQL} SELECT split, sum(n_tokens)::BIGINT AS tokens, sum(provided_tokens)::BIGINT AS provided, round(350000000 * 0.98 * (sum(n_tokens) / sum(provided_tokens)))::BIGINT AS projected FROM docs GROUP BY 1")
def token_projection(spark: SparkSession, d: str) -> DataFrame:
    """Expected model tokens of a full corpus from the measured ratio, rounded half to even."""
    a = _docs(spark, d).groupBy("split").agg(F.sum("n_tokens").alias("tokens"), F.sum("provided_tokens").alias("provided"))
    return a.select("*", F.bround(F.lit(350_000_000 * 0.98) * T.ratio(F.col("tokens"), F.col("provided"))).cast("bigint").alias("projected"))


@query("SELECT doc_ord, shard_index, split, (doc_ord % 4)::INT AS flags, (doc_ord % 4)::INT & 1 <> 0 AS append_end, (doc_ord % 4)::INT = 1 AS only_append_end, CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 WHEN 'test' THEN 2 END AS split_code FROM doc_index")
def flag_decode(spark: SparkSession, d: str) -> DataFrame:
    """Header flags by bit, and the code of each split."""
    f = (F.col("doc_ord") % 4).cast("int")
    codes = F.create_map(*[x for i, s in enumerate(("train", "validation", "test")) for x in (F.lit(s), F.lit(i))])
    return table(spark, d, "doc_index").select("doc_ord", "shard_index", "split", f.alias("flags"), (f.bitwiseAND(F.lit(1)) != 0).alias("append_end"), (f == 1).alias("only_append_end"), codes[F.col("split")].alias("split_code"))


@query("""WITH b AS (SELECT DISTINCT shard_index * 10 + doc_ord % 10 AS batch_index FROM doc_index), r AS (SELECT batch_index, unnest(range(4))::INT AS row FROM b), t AS (SELECT batch_index, row, list_transform(range(17), lambda i: (4 + ('0x' || substr(sha256('train:42:' || batch_index || ':' || row || ':' || i), 1, 12))::BIGINT % 16380)::INT) AS c FROM r)
SELECT batch_index, row, c[1:16] AS x, c[2:17] AS y FROM t""")
def synthetic_batches(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "doc_index").select((F.col("shard_index") * 10 + F.col("doc_ord") % 10).alias("batch_index")).distinct()
    return W.synthetic(b, "train", 42, 4, 16, K.VOCABULARY)


@query()
def generation_longest_repeat(spark: SparkSession, d: str) -> DataFrame:
    """Longest repeated run of each document's whole id list, of any length."""
    return G.longest_repeats(_docs(spark, d), "record_no", "tokens")
