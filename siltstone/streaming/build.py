"""Corpus builds: one-shot with budget, shards and publication, and a stream of micro-batches with durable state."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import validate as V
from ..operators.contracts import fingerprint
from ..operators.ordered import pack_close_after, running_before
from ..session import written
from ..sources.store import Store

#: Columns of the published records.
RECORDS = "source_ord bigint, text_sha256 string, id string, text string, url string, language string, language_score double, quality_score int, provided_token_count bigint, reason string, characters int, split string, packed_tokens bigint, shard_index int"


def within_budget(rows: DataFrame, target: int, so_far: int = 0) -> tuple[DataFrame, str]:
    """All source rows up to the kept row that reaches the token target, and the status; so_far tokens were kept before.

    Rows after it are not read, so they count nowhere; complete means the target was reached, source_exhausted that it was not.
    """
    if so_far >= target:
        return rows.limit(0), "complete"
    kept = rows.where("reason is null").select("source_ord", "provided_token_count")
    run = running_before(kept, F.col("provided_token_count"), "source_ord", out="b")
    last = run.where(F.col("b") < target - so_far).agg(F.max("source_ord"), F.sum("provided_token_count")).first()
    if last[0] is not None and last[1] + so_far >= target:
        return rows.where(F.col("source_ord") <= last[0]), "complete"
    return rows, "source_exhausted"


def build_corpus(raw: DataFrame, folder: str, cfg: C.CleanConfig, target: int, shard_target: int) -> dict:
    """Cleans, deduplicates, splits, cuts to the budget and shards, then validates and publishes by a rename.

    A finished output with the same fingerprint is verified and left as it is; with another one the build is refused.
    """
    spark = raw.sparkSession
    store, stage = Store(spark), f"{folder}.staging"
    mark = fingerprint({"config": asdict(cfg), "target": target, "shard_target": shard_target})
    if store.exists(folder):
        return verify_corpus(spark, folder, mark)
    store.delete(stage)  # an orphan of a build that did not end
    rows, status = within_budget(written(C.corpus(raw, cfg), "corpus"), target)
    C.sharded(rows, shard_target).write.partitionBy("shard_index").parquet(f"{stage}/records")
    manifest = describe(spark.read.schema(RECORDS).parquet(f"{stage}/records"), mark, status)
    if not manifest["conserved"]:
        raise RuntimeError("the built corpus doesn't add up")
    store.save(f"{stage}/manifest.json", manifest)
    store.rename(stage, folder)
    return manifest


def describe(rows: DataFrame, mark: str, status: str) -> dict:
    """The manifest of published records: totals, shards with the facts of their files, removals, and whether it all adds up."""
    shards = [r.asDict() for r in C.shard_metadata(rows).orderBy("shard_index").collect()]  # a row per storage shard
    kept = rows.where("reason is null").withColumn("line_number", F.col("source_ord"))
    files: dict[int, list[dict]] = {}
    for r in V.shard_files(kept).orderBy("path").collect():  # three rows per storage shard
        files.setdefault(r["shard_index"], []).append({k: r[k] for k in ("path", "records", "provided_tokens", "bytes", "sha256")})
    for s in shards:
        s["files"] = files.get(s["shard_index"], [])
    totals = {r["split"]: {"records": r["records"], "tokens": r["tokens"]} for r in C.split_totals(rows).collect()}
    c = C.conservation(rows).first()
    sums = all(s["kept_records"] == sum(f["records"] for f in s["files"]) for s in shards)
    return {
        "schema_version": 1, "fingerprint": mark, "status": status, "input": c["input"], "kept": c["kept"], "splits": totals, "shards": shards,
        "removed": {r["reason"]: r["records"] for r in C.removal_counts(rows).collect() if r["reason"] != "kept"}, "conserved": bool(c["rows_conserved"] and c["splits_conserved"] and sums and not C.split_overlap(rows).take(1)),
    }


def verify_corpus(spark: SparkSession, folder: str, mark: str) -> dict:
    """The published manifest, after its fingerprint, counts and digests are compared with the records on disk."""
    manifest = Store(spark).load(f"{folder}/manifest.json")
    if manifest["fingerprint"] != mark:
        raise RuntimeError("the output was built with another configuration")
    if describe(spark.read.schema(RECORDS).parquet(f"{folder}/records"), mark, manifest["status"]) != manifest:
        raise RuntimeError("the records differ from the manifest")
    return manifest


def _source_files(rows: DataFrame) -> list[list]:
    """Path and size of the files that rows were read from; a micro-batch has at most files_per_batch of them."""
    return [list(r) for r in rows.select("_path", "_size").distinct().orderBy("_path").collect()]


def stream_corpus(
    spark: SparkSession, source: str, folder: str, cfg: C.CleanConfig, target: int | None = None, shard_target: int | None = None, files_per_batch: int = 1, batches: int | None = None
) -> dict:
    """Runs all files that are there now as micro-batches and returns the state: fingerprint, status, batches, shards, tokens.

    A batch is cleaned, compared with the digests that earlier batches kept, cut to what is left of the token target, and
    packed into shards of shard_target (one shard, if there is none).  It writes records and digests under its own number by overwriting, and is registered in the
    state last; so a batch that is run again after a failure changes nothing else.  Digests are 32 bytes a kept record, and are all that later batches read.

    The state is ``running`` until the target is reached (``complete``; later runs change nothing) or the files are used up
    (``source_exhausted``; later runs go on with new files).  It is refused with another configuration, and if a file that was already
    taken is gone or has another size.  ``batches`` stops early, as an interruption would.
    """
    store = Store(spark)
    mark = fingerprint({"config": asdict(cfg), "target": target, "shard_target": shard_target})
    place = f"{folder}/state.json"
    state = store.load(place) if store.exists(place) else {"fingerprint": mark, "status": "running", "batches": []}
    if state["fingerprint"] != mark:
        raise RuntimeError("the stream was begun with another configuration")
    for b in state["batches"]:
        for path, size in b["files"]:
            if not store.exists(path):
                raise RuntimeError(f"the source ends before the committed place: {path} is gone")
            if store.size(path) != size:
                raise RuntimeError(f"{path} is not the file that was taken before")
    reconcile(store, folder, state)
    if state["status"] == "complete":
        return _summary(state)
    schema = spark.read.parquet(source).schema
    took = 0

    def commit(rows: DataFrame, number: int) -> None:
        nonlocal took
        if state["status"] == "complete" or any(b["number"] == number for b in state["batches"]):
            return
        if batches is not None and took >= batches:
            raise InterruptedError(number)
        files = _source_files(rows)
        judged = C.keep_first(written(C.judged(rows.drop("_path", "_size"), cfg), "judged"))
        if state["batches"]:
            paths = [f"{folder}/digests/batch={b['number']}" for b in state["batches"]]
            earlier = spark.read.schema("digest binary").parquet(*paths).select(F.lower(F.hex("digest")).alias("text_sha256"), F.lit(True).alias("_seen"))
            judged = judged.join(earlier, "text_sha256", "left").withColumn("reason", F.when(F.col("reason").isNull() & F.col("_seen"), C.REASONS[6]).otherwise(F.col("reason"))).drop("_seen")
        judged = written(C.with_split(judged, cfg), "batch")
        before = sum(b["tokens"] for b in state["batches"])
        cut, status = (judged, "running") if target is None else within_budget(judged, target, before)
        n = F.when(F.col("reason").isNull(), F.col("provided_token_count")).otherwise(F.lit(0))
        first = sum(b["shards"] for b in state["batches"])
        if shard_target is None:
            out = cut.withColumn("shard_index", F.lit(first))
        else:
            packed = pack_close_after(cut.select("source_ord", n.alias("packed_tokens")), "packed_tokens", "source_ord", shard_target)
            out = cut.join(packed.select("source_ord", (F.col("shard_index") + first).alias("shard_index")), "source_ord")
        out.write.mode("overwrite").parquet(f"{folder}/records/batch={number}")
        back = spark.read.schema(out.schema).parquet(f"{folder}/records/batch={number}")
        back.where("reason is null").select(F.unhex("text_sha256").alias("digest")).write.mode("overwrite").parquet(f"{folder}/digests/batch={number}")
        kept = F.col("reason").isNull()
        c = back.agg(F.count(F.lit(1)), F.count_if(kept), F.coalesce(F.sum(F.when(kept, F.col("provided_token_count"))), F.lit(0)), F.coalesce(F.max("shard_index") + 1 - first, F.lit(0))).first()
        state["batches"].append({"number": number, "files": files, "input": c[0], "kept": c[1], "tokens": c[2], "shards": c[3]})
        state["status"] = "complete" if status == "complete" else "running"
        store.save(place, state)
        took += 1

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream = stream.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_size").alias("_size"))
    q = stream.writeStream.foreachBatch(commit).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    except Exception:
        if batches is None:
            raise
        return _summary(state)
    if state["status"] != "complete":
        store.save(place, state | {"status": "source_exhausted"})
        return _summary(state) | {"status": "source_exhausted"}
    return _summary(state)


def reconcile(store: Store, folder: str, state: dict) -> None:
    """Drops what no registered batch accounts for, and makes sure that what is registered is there."""
    known = {f"batch={b['number']}" for b in state["batches"]}
    for part in ("records", "digests"):
        there = store.names(f"{folder}/{part}")
        for name in there:
            if name not in known:
                store.delete(f"{folder}/{part}/{name}")
        if known - set(there):
            raise RuntimeError(f"{sorted(known - set(there))[0]} is registered but its {part} are gone")
    for name in store.names(folder):
        if name.endswith(".part"):
            store.delete(f"{folder}/{name}")


def _summary(state: dict) -> dict:
    b = state["batches"]
    return {"fingerprint": state["fingerprint"], "status": state["status"], "committed": len(b), **{k: sum(x[k] for x in b) for k in ("input", "kept", "tokens", "shards")}}
