import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import ordered as O
from siltstone.operators import tokens as K
from siltstone.operators import windows as W


def test_running_sum_over_ranges(spark):
    rng = random.Random(1)
    rows = [(i * 3, rng.choice([None, 0, 5, 7]), rng.choice("ab")) for i in range(3000)]
    d = spark.createDataFrame(rows, "o bigint, v bigint, g string")
    got = {r["o"]: r["before"] for r in O.running_before(d, F.col("v"), "o", ["g"]).collect()}
    seen = {"a": 0, "b": 0}
    for o, v, g in rows:
        assert got[o] == seen[g]
        seen[g] += v or 0
    assert O.running_before(d.limit(0), F.col("v"), "o").count() == 0


def folded(v, target, after, n=0, shard=0):
    """(shard of each row, tokens and number of the open shard) of the packing, row by row."""
    out = []
    for x in v:
        if not after and n and n + x > target:
            shard, n = shard + 1, 0
        n += x
        out.append(shard)
        if after and n >= target:
            shard, n = shard + 1, 0
    return out, n, shard


@pytest.mark.parametrize("after", [True, False])
def test_ranges_of_a_packing_string_together(after):
    """From every state that a range can be entered with, its table tells the state at its end, and its rows get the shards of the loop."""
    rng = random.Random(4)
    for _ in range(1500):
        target = rng.randrange(1, 30)
        v = [rng.choice([0, 0, 1, 2, 5, rng.randrange(0, target * 2 + 1)]) for _ in range(rng.randrange(1, 40))]
        x = np.array(v, np.int64)
        table = O._transfer(x, target, after)
        for n in range(target if after else target * 2):
            want, left, shard = folded(v, target, after, n, 3)
            got, m, s = O._assigned(x, n, 3, target, after)
            assert (got.tolist(), m, s) == (want, left, shard)
        parts = [v[:7], v[7:20], v[20:]]
        ranges = [("k", i, sum(p), *O._transfer(np.array(p, np.int64), target, after)) for i, p in enumerate(parts) if p]
        at = 0
        for (_, i, n, shard), p in zip(O._entries(ranges, after), [p for p in parts if p]):
            assert (n, shard) == folded(v[:at], target, after)[1:]
            at += len(p)
        assert len(table[0]) == len(table[1]) == len(table[2]) and table[0] == sorted(table[0])


def test_folds_match_a_loop(spark, monkeypatch):
    monkeypatch.setattr(O, "SHARDS", 2)
    rng = random.Random(2)
    rows = [(i * 3, rng.choice([rng.randrange(0, 90), 300]) if i % 7 else None, [None, "a", "b", "b"][i % 4]) for i in range(900)]
    d = spark.createDataFrame(rows, "o bigint, n bigint, split string").repartition(5)
    got = {r["o"]: (r["n"], r["shard_index"]) for r in O.pack_close_after(d, "n", "o", 200).collect()}
    assert got == {o: (n, s) for (o, n, _), s in zip(rows, folded([n or 0 for _, n, _ in rows], 200, True)[0])}
    plan = O.pack_close_after(d, "n", "o", 200)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    got = {r["o"]: (r["split"], r["shard_index"]) for r in O.pack_close_before(d, "n", "o", 60).collect()}
    for k in (None, "a", "b"):
        mine = [(o, n or 0) for o, n, s in rows if s == k]
        assert {o: got[o] for o, _ in mine} == {o: (k, s) for (o, _), s in zip(mine, folded([n for _, n in mine], 60, False)[0])}
    assert O.pack_close_after(d.limit(0), "n", "o", 5).count() == O.pack_close_before(d.limit(0), "n", "o", 5).count() == 0
    with pytest.raises(ValueError):
        O.pack_close_after(d, "n", "o", 0)


def test_budget_keeps_the_row_that_crosses(spark):
    d = spark.createDataFrame([(i, 100) for i in range(10)], "o bigint, n bigint")
    assert sorted(r["o"] for r in O.budget_prefix(d, "n", "o", 350).collect()) == [0, 1, 2, 3]


EPOCH_SEED = 3238574574694594684  # of "train:42:0"


def stream(spark):
    rows = [("train", 0, 0, [10, 11, 1]), ("train", 1, 0, [20, 21, 22, 1]), ("train", 2, 0, [30, 31, 32, 33, 1])]
    d = spark.createDataFrame(rows, "split string, shard_index int, doc_ord bigint, tokens array<int>").withColumn("n_tokens", F.size("tokens"))
    return K.offsets(d)


def test_windows_cross_documents(spark):
    s = stream(spark)
    flat = [10, 11, 1, 20, 21, 22, 1, 30, 31, 32, 33, 1]
    for t in (1, 3, 4, 7):
        got = W.sequential(s, t).orderBy("window_id").collect()
        assert [r["x"] for r in got] == [flat[k * t : k * t + t] for k in range((len(flat) - 1) // t)]
        assert all(r["y"] == flat[r["start"] + 1 : r["start"] + 1 + t] for r in got)
    starts = spark.createDataFrame([("train", i, i) for i in range(8)], "split string, sample_index bigint, start bigint")
    got = {r["start"]: (r["x"], r["y"]) for r in W.at_starts(s, starts, 4).collect()}
    assert got[2] == (flat[2:6], flat[3:7]) and len(got) == 8


def test_sampler_repeats_and_changes_with_the_epoch(spark):
    s = spark.range(200).withColumnRenamed("id", "sample_index")
    draw = lambda e: [r["start"] for r in W.sample_starts(s, F.lit(8), 42, e).orderBy("sample_index").collect()]
    assert draw(3) == draw(3) != draw(4) and set(draw(3)) <= set(range(8))


def test_index_gaps(spark):
    rows = [("t", 0, 0, 0, 5), ("t", 0, 1, 5, 3), ("t", 0, 2, 9, 2), ("t", 0, 3, 10, 2), ("t", 0, 3, 10, 2), ("t", 0, 4, 12, 0)]
    d = spark.createDataFrame(rows, "split string, shard_index int, doc_ord bigint, start_token bigint, length_tokens bigint").withColumn("text_sha256", F.unhex(F.lit("00")))
    assert [r["violation"] for r in K.index_gaps(d).orderBy("doc_ord").collect()] == ["gap", "overlap", "repeated", "zero_length"]


def test_dummy_tokenizer(spark):
    d = spark.createDataFrame([("ab\U0001f916",), ("",)], "t string").select(K.code_point_ids(F.col("t")).alias("i")).collect()
    assert d[0]["i"] == [100 + ord(c) % 97 for c in "ab\U0001f916"] + [1] and d[1]["i"] == [1]


def test_seeds_and_synthetic_batches(spark):
    import hashlib

    for name, seed, epoch in (("a", 1, 2), ("train", 42, 0), ("x", 0, 10**6)):
        first = hashlib.sha256(f"{name}:{seed}:{epoch}".encode()).digest()[:8]
        assert W.epoch_seed(name, seed, epoch) == sum(b << 8 * i for i, b in enumerate(first)) % 2**63
    assert W.epoch_seed("train", 42, 0) == EPOCH_SEED and W.epoch_seed("a", 1, 2) != W.epoch_seed("a", 1, 3)
    with pytest.raises(ValueError):
        W.epoch_seed("a", 1, -1)
    b = spark.range(3).withColumnRenamed("id", "batch_index")
    whole = {(r["batch_index"], r["row"]): r["x"] for r in W.synthetic(b, "s", 7, 2, 5, 100).collect()}
    one = {(r["batch_index"], r["row"]): r["x"] for r in W.synthetic(b.where("batch_index = 2"), "s", 7, 2, 5, 100).collect()}
    assert one == {k: v for k, v in whole.items() if k[0] == 2} and all(4 <= t < 100 for v in whole.values() for t in v)
