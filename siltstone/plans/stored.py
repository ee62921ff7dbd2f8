"""Queries whose results rest on files or libraries, checked by rows or by unit tests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bpe
from ..operators import clean as C
from ..operators import tokens as K
from ..session import shared_dir, written
from ..sources import binary
from ..sources.store import Store
from ..streaming import build
from ..streaming import tokens as token_build
from ..streaming.tokens import packed
from .base import TOKENS_SQL, clean, corpus_sql, query, raw, table


@query("""WITH w AS (SELECT unnest(regexp_extract_all(text, '\\p{L}+')) AS w FROM documents), c AS (SELECT w, count(*) AS c FROM w GROUP BY 1 HAVING length(w) > 1), p AS (SELECT c, w, unnest(range(1, length(w))) AS i FROM c)
SELECT substr(w, i, 1) AS left, substr(w, i + 1, 1) AS right, sum(c)::BIGINT AS n FROM p GROUP BY 1, 2""")
def bpe_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return bpe.pair_counts(table(spark, d, "documents"))


@query()
def bpe_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return bpe.round_trip(table(spark, d, "documents"), "doc_id", "text", 50_256)


_PACK = """WITH RECURSIVE {0}, o AS (SELECT split, n_tokens::BIGINT AS n, text_sha256, sha256('[' || array_to_string(tokens, ',') || ']') AS ids_sha256, row_number() OVER (PARTITION BY split ORDER BY shard_index, doc_ord) AS i FROM docs),
fold(split, i, n, shard, total, text_sha256, ids_sha256) AS (SELECT split, i, n, 0, n, text_sha256, ids_sha256 FROM o WHERE i = 1 UNION ALL
 SELECT o.split, o.i, o.n, CASE WHEN f.total + o.n > 2000000 THEN f.shard + 1 ELSE f.shard END, CASE WHEN f.total + o.n > 2000000 THEN o.n ELSE f.total + o.n END, o.text_sha256, o.ids_sha256 FROM fold f JOIN o ON o.split = f.split AND o.i = f.i + 1)
SELECT split, shard AS shard_index, row_number() OVER (PARTITION BY split, shard ORDER BY i) - 1 AS doc_ord, n AS length_tokens, (sum(n) OVER (PARTITION BY split, shard ORDER BY i) - n)::BIGINT AS start_token, (sum(n) OVER (PARTITION BY split ORDER BY i) - n)::BIGINT AS global_start, text_sha256, ids_sha256 FROM fold"""


@query(_PACK.format(TOKENS_SQL))
def binary_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Packs all token documents into shards, writes them as binary files, and reads payload and index back: place, length, text digest and ids of each document."""
    docs = written(K.token_documents(clean(spark, d)).withColumn("place", F.col("shard_index").cast("bigint") * 1_000_000_000 + F.col("doc_ord")).select("split", "place", "tokens", "n_tokens", "text_sha256"), "documents")
    folder = f"{shared_dir(spark)}/siltstone/shards-{uuid.uuid4().hex}"
    binary.write_shards(packed(docs, 2_000_000), folder).write.format("noop").mode("overwrite").save()
    back = written(binary.read_documents(spark, folder).select("split", "shard_index", "doc_ord", "start_token", "length_tokens", (F.col("token_start") + F.col("start_token")).alias("global_start"), "text_sha256", T.ids_digest(F.col("tokens")).alias("ids_sha256")), "back")
    Store(spark).delete(folder)
    return back


_BUILT = corpus_sql()


@query(f"""WITH RECURSIVE {_BUILT}, w AS (SELECT source_ord, CASE WHEN reason IS NULL THEN provided_token_count ELSE 0 END AS n, row_number() OVER (ORDER BY source_ord) AS i FROM corpus),
fold(i, n, shard, total, closed) AS (SELECT i, n, 0, n, n >= 50000 FROM w WHERE i = 1 UNION ALL SELECT w.i, w.n, CASE WHEN fold.closed THEN fold.shard + 1 ELSE fold.shard END, CASE WHEN fold.closed THEN w.n ELSE fold.total + w.n END, CASE WHEN fold.closed THEN w.n ELSE fold.total + w.n END >= 50000 FROM fold JOIN w ON w.i = fold.i + 1),
a AS (SELECT count(*) AS input, count(*) FILTER (WHERE reason IS NULL) AS kept, coalesce(sum(provided_token_count) FILTER (WHERE reason IS NULL), 0)::BIGINT AS tokens FROM corpus)
SELECT run, 'source_exhausted' AS status, input, kept, tokens, (SELECT count(DISTINCT shard) FROM fold) AS shards, true AS same FROM a, (VALUES ('built'), ('again')) r(run)""")
def publish_resume_idempotent(spark: SparkSession, d: str) -> DataFrame:
    """A corpus built and published in the shared folder, and the build run again, which verifies it and changes nothing."""
    folder = f"{shared_dir(spark)}/siltstone/corpus-{uuid.uuid4().hex}"
    cfg = C.CleanConfig()
    made = [build.build_corpus(raw(spark, d), folder, cfg, 10**12, 50_000) for _ in range(2)]
    Store(spark).delete(folder)
    rows = [(run, m["status"], m["input"], m["kept"], sum(s["tokens"] for s in m["splits"].values()), len(m["shards"]), m == made[0]) for run, m in zip(("built", "again"), made)]
    return spark.createDataFrame(rows, "run string, status string, input bigint, kept bigint, tokens bigint, shards bigint, same boolean")


@query(f"WITH {TOKENS_SQL}, a AS (SELECT split, count(*) AS documents, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY 1) SELECT split, documents, tokens, 64 + 2 * tokens AS least_bytes, true AS same FROM a")
def token_build_resume(spark: SparkSession, d: str) -> DataFrame:
    """A token corpus whose build is broken off after the first split, taken up again, and verified by a third run."""
    docs = K.token_documents(clean(spark, d)).withColumn("place", F.col("shard_index").cast("bigint") * 1_000_000_000 + F.col("doc_ord")).select("split", "place", "tokens", "n_tokens", "text_sha256")
    docs = written(docs, "documents")
    folder = f"{shared_dir(spark)}/siltstone/tokens-{uuid.uuid4().hex}"
    who = {"tokenizer": "code points", "source": d}
    token_build.build_tokens(docs, folder, 2_000_000, who, splits=1)
    made = [token_build.build_tokens(docs, folder, 2_000_000, who) for _ in range(2)]
    Store(spark).delete(folder)
    parts: dict[str, int] = {}
    for s in made[0]["shards"]:
        parts[s["split"]] = parts.get(s["split"], 0) + s["bytes"] - 64
    rows = [(s, t["documents"], t["tokens"], 64 + parts[s], made[0] == made[1]) for s, t in made[0]["splits"].items()]
    return spark.createDataFrame(rows, "split string, documents bigint, tokens bigint, least_bytes bigint, same boolean")
