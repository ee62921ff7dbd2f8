"""Token corpora as binary shards, built in a staging folder that can be taken up again."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.contracts import fingerprint
from ..operators.ordered import pack_close_before
from ..session import written
from ..sources import binary
from ..sources.store import Store

SPLITS = ("train", "validation", "test")


def packed(docs: DataFrame, target: int) -> DataFrame:
    """docs (split, place, tokens, n_tokens, text_sha256) with shard_index, doc_ord, and the shard's token_start and document_start in its split."""
    shards = written(pack_close_before(docs, "n_tokens", "place", target), "packed")
    sums = shards.groupBy("split", "shard_index").agg(F.sum("n_tokens").alias("_t"), F.count(F.lit(1)).alias("_d"))
    before = Window.partitionBy("split").orderBy("shard_index").rowsBetween(Window.unboundedPreceding, -1)  # a row per storage shard
    sums = sums.select("split", "shard_index", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("token_start"), F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("document_start"))
    return docs.join(shards.select("split", "place", "shard_index"), ["split", "place"]).join(sums, ["split", "shard_index"]).withColumnRenamed("place", "doc_ord")


def reconcile(spark: SparkSession, folder: str, registered: list[dict]) -> None:
    """Drops temporary and unregistered files; registered ones must be there with their size and digest."""
    store = Store(spark)
    known = {f"{s['name']}{x}" for s in registered for x in (".bin", ".idx")}
    there = store.names(folder)
    for name in there:
        if name not in known and name != "state.json":
            store.delete(f"{folder}/{name}")
    for s in registered:
        if not {f"{s['name']}.bin", f"{s['name']}.idx"} <= set(there) or store.size(f"{folder}/{s['name']}.bin") != s["bytes"]:
            raise RuntimeError(f"the registered shard {s['name']} is not as it was")
    if registered:
        paths = [f"{folder}/{s['name']}.bin" for s in registered]
        found = {r[0]: r[1] for r in spark.read.format("binaryFile").load(paths).select(F.regexp_extract("path", "([^/]+)\\.bin$", 1), F.sha2("content", 256)).collect()}  # a row per storage shard
        for s in registered:
            if found.get(s["name"]) != s["sha256"]:
                raise RuntimeError(f"the registered shard {s['name']} has other bytes")


def build_tokens(docs: DataFrame, folder: str, target: int, identity: dict, splits: int | None = None) -> dict:
    """Packs, writes and validates all shards, and publishes them by a rename; returns the manifest.

    identity names what the ids rest on (configuration, source and tokenizer digests); a staging folder or an output of another identity is
    refused.  Splits are written one after the other and registered, so a build that was broken off goes on with the split
    it was in; a finished output is verified and left as it is.  ``splits`` stops after so many, as an interruption would.
    """
    spark = docs.sparkSession
    store, stage = Store(spark), f"{folder}.staging"
    mark = fingerprint({"identity": identity, "target": target})
    if store.exists(folder):
        return verify_tokens(spark, folder, mark)
    place = f"{stage}/state.json"
    state = store.load(place) if store.exists(place) else {"fingerprint": mark, "status": "running", "splits": [], "shards": []}
    if state["fingerprint"] != mark:
        raise RuntimeError("the staging folder belongs to another configuration, source or tokenizer")
    reconcile(spark, stage, state["shards"])
    store.save(place, state)
    rows = packed(docs, target)
    took = 0
    for split in SPLITS:
        if split in state["splits"]:
            continue
        if splits is not None and took >= splits:
            return state
        made = binary.write_shards(rows.where(F.col("split") == split), stage).orderBy("shard_index").collect()  # a row per storage shard
        state["shards"] += [{"name": f"{r['split']}-{r['shard_index']:05d}", "split": r["split"], "documents": r["documents"], "tokens": r["tokens"], "bytes": r["bytes"], "sha256": r["sha256"]} for r in made]
        state["splits"].append(split)
        store.save(place, state)
        took += 1
    manifest = manifest_of(spark, stage, state)
    store.delete(place)
    store.save(f"{stage}/manifest.json", manifest)
    store.rename(stage, folder)
    return manifest


def manifest_of(spark: SparkSession, folder: str, state: dict) -> dict:
    """Shards and split totals, after every payload and index was read back and compared with them."""
    back = binary.read_documents(spark, folder).groupBy("split").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("tokens")).alias("tokens"))
    found = {r["split"]: {"documents": r["documents"], "tokens": r["tokens"]} for r in back.collect()}
    stated: dict[str, dict] = {}
    for s in state["shards"]:
        t = stated.setdefault(s["split"], {"documents": 0, "tokens": 0})
        t["documents"] += s["documents"]
        t["tokens"] += s["tokens"]
    if found != stated:
        raise RuntimeError("the shards differ from what was registered")
    digest = hashlib.sha256("".join(s["sha256"] for s in state["shards"]).encode()).hexdigest()
    return {"schema_version": 1, "fingerprint": state["fingerprint"], "status": "complete", "splits": stated, "shards": state["shards"], "sha256": digest}


def verify_tokens(spark: SparkSession, folder: str, mark: str) -> dict:
    manifest = Store(spark).load(f"{folder}/manifest.json")
    if manifest["fingerprint"] != mark:
        raise RuntimeError("the output was built from another configuration, source or tokenizer")
    if manifest_of(spark, folder, manifest | {"shards": manifest["shards"]}) != manifest:
        raise RuntimeError("the shards differ from the manifest")
    return manifest
