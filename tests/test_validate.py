"""Validation operators on fixtures with planted faults, nulls and empty tables."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from siltstone.operators import bench as B
from siltstone.operators import contracts as K
from siltstone.operators import tokens as TK
from siltstone.operators import validate as V
from siltstone.operators import windows as W


def failed(df):
    return {r["rule"]: r["failed"] for r in df.collect()}


def digest(*texts):
    return hashlib.sha256("".join("" if t is None else hashlib.sha256(t.encode()).hexdigest() for t in texts).encode()).hexdigest()


def test_shard_files_and_their_differences(spark):
    rows = [(0, "train", 2, 5, "b"), (0, "train", 1, None, "é"), (0, "test", 1, 7, None), (1, "train", 1, 1, ""), (None, "train", 1, 1, "x"), (1, None, 1, 1, "x")]
    d = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "shard_index int, split string, line_number bigint, provided_token_count bigint, text string, path string, sha256 string")
    got = {r["path"]: (r["records"], r["provided_tokens"], r["bytes"], r["sha256"]) for r in V.shard_files(d).collect()}
    assert got == {"shards/shard-00000/train.jsonl": (2, 5, 5, digest("é", "b")), "shards/shard-00000/test.jsonl": (1, 7, 1, digest(None)), "shards/shard-00001/train.jsonl": (1, 1, 1, digest(""))}
    files = lambda *r: spark.createDataFrame(list(r), "path string, records bigint, sha256 string")
    diff = V.file_differences(files(("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("e", 1, None)), files(("a", 1, "x"), ("b", 2, "x"), ("c", 1, "y"), ("d", 1, "x"), ("e", 1, None)))
    assert {r["path"]: r["state"] for r in diff.collect()} == {"b": "size", "c": "digest", "d": "extra"}
    assert {r["path"]: r["state"] for r in V.file_differences(files(("a", 1, "x")), files()).collect()} == {"a": "missing"}
    assert V.shard_files(d.limit(0)).count() == 0


def test_manifest_rules(spark):
    shape = "shard_index int, source_start bigint, source_end bigint, source_records bigint, kept_records bigint, removed_records bigint, provided_tokens bigint"
    good = [(0, 0, 5, 5, 4, 1, 40), (1, 5, 9, 4, 4, 0, 44)]
    splits = lambda *r: spark.createDataFrame(list(r), "split string, records bigint, tokens bigint")
    check = lambda rows, s, target=None: {k for k, v in failed(V.manifest_rules(spark.createDataFrame(rows, shape), s, target)).items() if v}
    fine = splits(("train", 6, 60), ("validation", 1, 12), ("test", 1, 12))
    assert check(good, fine, 84) == set() and check(good, fine, 85) == {"target_reached"}
    assert check(good, splits(("train", 8, 84), ("test", 0, 0))) == {"split_not_empty"}
    assert check([good[0], (2, 6, 9, 4, 4, 0, 44)], fine) == {"contiguous_indexes", "contiguous_ranges"}
    assert check([good[0], (1, 5, 9, 5, 4, 0, 45)], fine) == {"records_conserved", "shards_add_up_to_splits"}


def test_stream_rules_and_headers(spark):
    shape = "split string, shard_index int, documents bigint, tokens bigint, token_start bigint, document_start bigint, ends bigint, least int, greatest int"
    good = [("train", 0, 2, 9, 0, 0, 2, 1, 50), ("train", 1, 1, 4, 9, 2, 1, 1, 60), ("test", 0, 1, 2, 0, 0, 1, 1, 7)]
    check = lambda rows: {k for k, v in failed(V.stream_rules(spark.createDataFrame(rows, shape))).items() if v}
    assert check(good) == set()
    assert check([good[0], ("train", 1, 1, 4, 8, 1, 0, 5, 4)]) == {"token_prefix", "document_prefix", "an_end_per_document", "least_within_greatest"}
    assert check([("train", 1, 0, 0, 0, 0, 0, None, None)]) == {"contiguous_shards", "least_within_greatest", "not_empty"}
    one = lambda *r: spark.createDataFrame(list(r), "split string, shard_index int, documents bigint, tokens bigint")
    diff = V.header_differences(one(("a", 0, 2, 9), ("a", 1, 1, 4)), one(("a", 0, 2, 8), ("b", 0, 1, None)), ["split", "shard_index"], ["documents", "tokens"])
    assert {(r["split"], r["shard_index"], r["field"], r["actual"], r["stated"]) for r in diff.collect()} == {("a", 0, "tokens", 9, 8), ("a", 1, "documents", 1, None), ("a", 1, "tokens", 4, None), ("b", 0, "documents", None, 1)}
    sums = {(r["level"], r["split"], r["shard_index"]): r["equal"] for r in TK.shard_equalities(spark.createDataFrame([("a", 0, 4), ("a", 0, 5), ("a", 1, 4)], "split string, shard_index int, n_tokens int"), one(("a", 0, 2, 9), ("a", 1, 1, 5))).collect()}
    assert sums == {("shard", "a", 0): True, ("shard", "a", 1): False, ("split", "a", None): False, ("total", None, None): False}


def test_tokens_at_places(spark):
    rng = random.Random(3)
    flat, docs = [], []
    for i in range(40):
        ids = [rng.randrange(2, 99) for _ in range(rng.randrange(0, 60))] + [1]
        docs.append(("a", 0, i, len(flat), len(ids), ids))
        flat += ids
    d = spark.createDataFrame(docs, "split string, shard_index int, doc_ord bigint, start_token bigint, n_tokens int, tokens array<int>")
    places = [0, 5, 5, len(flat) - 1, len(flat), -1, 500]
    p = spark.createDataFrame([("a", 0, x) for x in places] + [("b", 0, 1)], "split string, shard_index int, position bigint")
    got = V.token_at(d, p, ["split", "shard_index"], cell=16).collect()
    assert sorted((r["split"], r["position"], r["token"] or 0) for r in got) == sorted([("a", x, flat[x] if 0 <= x < len(flat) else 0) for x in places] + [("b", 1, 0)])
    index = spark.createDataFrame([("a", 0, i, s, n + (i == 7)) for _, _, i, s, n, _ in docs], "split string, shard_index int, doc_ord bigint, start_token bigint, length_tokens bigint")
    assert {r["doc_ord"] for r in V.end_tokens(index, d).where("not ends").collect()} == {7} - ({7} if len(docs[8][5]) == 1 else set())
    assert V.token_at(d.limit(0), p, ["split", "shard_index"]).where("token is not null").count() == 0


def test_contracts_of_configurations(spark):
    docs = [(1, {"a": {"b": 1}, "p": "x"}), (2, {"a": {"b": 9}, "p": 5}), (3, {"a": {"b": 1.5}, "z": None}), (4, None)]
    d = spark.createDataFrame([(i, None if x is None else json.dumps(x)) for i, x in docs] + [(5, "{"), (6, '{"a": 1, "a": 2}')], "id bigint, c string")
    flat = K.flat_table(d, "id", "c")
    got = {(r["id"], r["path"], r["violation"]) for r in V.config_violations(flat, [("a.b", "int", 0.0, 5.0), ("p", "str", None, None)], "id").collect()}
    assert got == {(2, "a.b", "range"), (2, "p", "type"), (3, "a.b", "type"), (3, "p", "missing"), (3, "z", "unexpected")}
    x = flat.where("id = 1").drop("id")
    assert {r["path"]: r["held"] for r in K.held_constant(x, flat.where("id = 3").drop("id"), ["a.b", "q"]).collect()} == {"a.b": False, "q": False}
    diff = K.difference(x, flat.where("id = 2").drop("id"))
    assert {(r["path"], r["left_value"], r["right_value"]) for r in diff.collect()} == {("a.b", "1", "9"), ("p", '"x"', "5")}
    pairs = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    d3 = spark.createDataFrame([(1, "m.d"), (2, "m.d"), (2, "x")], "id bigint, path string")
    h3 = spark.createDataFrame([(1, "s", True), (2, "s", True), (3, "s", False)], "id bigint, path string, held boolean")
    assert {r["id"]: (r["differing"], r["valid"]) for r in V.ablation(d3, h3, pairs, "id", "m.d").collect()} == {1: (1, True), 2: (2, False), 3: (0, False)}


def test_forbidden_keys_and_paths(spark):
    tree = {"Api_Key": {"x": [1]}, "run": {"out_path": "../Home/u", "paths": ["ok", "C:\\data"], "home": "/home/u", "note": "home/u"}, "n": None}
    flat = K.tree_table(spark, tree)
    got = {(r["path"], r["violation"]) for r in K.forbidden(flat).collect()}
    assert got == {("Api_Key.x[0]", "credential_key"), ("run.out_path", "private_path"), ("run.paths[1]", "private_path")}
    assert K.forbidden(flat.limit(0)).count() == 0


def test_decisions_and_runs(spark):
    m = spark.createDataFrame([(0.5, True, None)], "err double, ok boolean, none double")
    limits = {"err": ("<=", 0.5), "ok": ("==", True), "none": ("<=", 1.0)}
    assert {r["gate"]: r["passed"] for r in V.decision(m, limits).collect()} == {"err": True, "ok": True, "none": False}
    assert not any(r["passed"] for r in V.decision(m.limit(0), limits).collect())
    shape = "sequence_index bigint, pair_index bigint, strategy string, prompt_tokens int, generated int, returned int, prefill double, ttft double, wall double, decode_rate double"
    rows = [(0, 0, "r", 3, 5, 8, 0.1, 0.2, 1.2, 4.0), (1, 0, "c", 3, 5, 8, 0.1, 0.2, 1.2, 4.0), (2, 1, "r", 3, 5, 9, 0.1, 0.2, 1.2, 4.0), (3, 1, "c", 3, 5, 8, 0.3, 0.2, 1.2, 4.0), (4, 2, "r", 3, 5, 8, 0.1, 0.2, 1.2, 4.01), (5, 2, "c", 3, 1, 4, 0.1, 0.2, 1.2, None), (6, 3, "c", 3, 5, 8, 0.1, 0.2, 1.2, 4.0), (9, 4, "r", 3, 5, 8, 0.1, 0.2, 1.2, 4.0)]
    plan = spark.createDataFrame([(i, "rc"[i % 2]) for i in range(8)], "sequence_index bigint, planned string")
    got = {r["sequence_index"]: r["violation"] for r in V.run_rows(spark.createDataFrame(rows, shape), plan).collect()}
    assert got == {0: None, 1: None, 2: "returned", 3: "times", 4: "rate", 5: "pair", 6: "strategy", 7: "missing", 9: "unplanned"}


def test_loaders_batches_and_cursors(spark):
    c = spark.createDataFrame([("m", 3, 5.0, "ok"), ("m", 1, 5.0, "ok"), ("m", 0, 9.0, "oom"), ("n", 1, None, "ok")], "model string, candidate int, rate double, status string")
    assert [(r["model"], r["candidate"]) for r in B.best_loader(c, ["model"]).collect()] == [("m", 1)]
    g = B.loader_grid(spark.createDataFrame([(0, 2), (1, 4), (2, 2)], "ordinal int, workers int"), [True, False], 8, 2).orderBy("ordinal").collect()
    assert [r["key"] for r in g] == ["b8-a2-w2-p1", "b8-a2-w2-p0", "b8-a2-w4-p1", "b8-a2-w4-p0", "b8-a2-w2-p1", "b8-a2-w2-p0"] and [r["repeated"] for r in g] == [False] * 4 + [True] * 2
    rows = spark.range(23).withColumnRenamed("id", "i")
    assert [(r["batch_id"], r["samples"]) for r in W.batches(rows, "i", 5, False).orderBy("batch_id").collect()] == [(0, 5), (1, 5), (2, 5), (3, 5), (4, 3)]
    assert W.batches(rows, "i", 5, True).count() == 4 and W.batches(rows, "i", 5, True, first=2).count() == 2 and W.batches(rows, "i", 5, False, first=9).count() == 5
    at = spark.createDataFrame([(0, 40), (16, 40), (20, 40), (48, 40), (None, 40)], "c bigint, t bigint")
    got = at.select("c", *[v.alias(k) for k, v in W.cursor(F.col("c"), F.col("t"), 4, 4).items()]).collect()
    assert [(r["remaining"], r["micro_batches"], r["updates"], r["unused"], r["valid"]) for r in got[:4]] == [(40, 10, 2, 8, True), (24, 6, 1, 8, True), (20, 5, 1, 4, False), (0, 0, 0, 0, False)]
    assert not got[4]["valid"]
