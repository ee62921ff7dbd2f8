"""Comparisons of each row with the one of the following key: nothing is broadcast, and odd keys and documents count as in the joins."""

import json
import random

import pytest

from siltstone.operators import contracts as K
from siltstone.operators import validate as V
from siltstone.plans.catalogue import QUERIES


@pytest.mark.parametrize("name", ["ablation_contract_check", "config_diff", "held_constants", "topk_overlap", "array_first_divergence"])
def test_nothing_is_broadcast(spark, sf, name):
    """Estimates from compressed files let Spark broadcast whole tables, which the driver then held."""
    assert "Broadcast" not in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def joined(spark, rows):
    """Keys, differences and held paths by the operators on flattened tables."""
    d = spark.createDataFrame(rows, "id bigint, c string")
    flat = K.flat_table(d, "id", "c")
    both = {i for i, _ in rows} & {i - 1 for i, _ in rows if i is not None}
    keep = lambda f: f.where(f.id.isin(sorted(both)))
    return d, sorted(both), keep(flat), keep(flat.withColumn("id", flat.id - 1))


def test_neighbours_as_joins_have_them(spark):
    rng = random.Random(5)

    def tree(depth=0):
        if depth < 3 and rng.random() < 0.6:
            return {rng.choice(["a", "b", "a.b", "x[0]"]): tree(depth + 1) for _ in range(rng.randrange(4))} if rng.random() < 0.7 else [tree(depth + 1) for _ in range(3)]
        return rng.choice([0, 1, 1.0, -2, 1e300, True, None, "1", "a:1,b", 10**30, {}, []])

    ids = [-1025, -1024, -1023, -1, 0, 1, 2, 1022, 1023, 1024, 1025, 1026, 2047, 2048, 2049, 5000]
    rows = [(i, json.dumps(tree(), separators=rng.choice([(",", ":"), (", ", ": ")]))) for i in ids]
    rows += [(3, '{"a.b": 1, "a": {"b": 2}}'), (4, '{"a": {"b": 2}, "a.b": 3}'), (5, '{"a": 01}'), (6, '{"a": 1, "a": 1}'), (7, None), (8, '{"a": 1}'), (None, "{}")]
    rng.shuffle(rows)
    d, both, a, b = joined(spark, rows)
    blocks = K.neighbours(d, "id")
    assert sorted(map(str, K.neighbour_differences(blocks, "id", "c").collect())) == sorted(map(str, K.difference(a, b, ["id"]).collect()))
    held = K.neighbour_held(blocks, "id", "c", ["a.b", "a", "q"])
    want = {(r["id"], r["path"], r["held"]) for r in K.held_constant(a, b, ["a.b", "a", "q"], "id").collect()} | {(i, p, False) for i in (5, 6) for p in ("a.b", "a", "q")}  # neither side of these has a leaf
    assert {tuple(r) for r in held.collect()} == want and {r["id"] for r in held.collect()} == set(both)
    pairs = spark.createDataFrame([(i,) for i in both], "id bigint")
    verdicts = K.neighbour_ablation(blocks, "id", "c", "a", ["a.b"])
    assert sorted(map(str, verdicts.collect())) == sorted(map(str, V.ablation(K.difference(a, b, ["id"]), K.neighbour_held(blocks, "id", "c", ["a.b"]), pairs, "id", "a").collect()))
    assert K.neighbour_differences(K.neighbours(d.limit(0), "id"), "id", "c").count() == 0


def test_equal_keys_meet_every_follower(spark):
    d = spark.createDataFrame([(1, '{"a":1}'), (1, '{"a":2}'), (2, '{"a":2}'), (2, '{"a":3}'), (3, '{"a":3}')], "id bigint, c string")
    got = K.neighbour_differences(K.neighbours(d, "id"), "id", "c").collect()
    assert sorted(tuple(r) for r in got) == [(1, "a", "1", "2"), (1, "a", "1", "3"), (1, "a", "2", "3"), (2, "a", "2", "3")]


def test_documents_of_one_shape_are_read_as_each_alone():
    shared = K._Reader()
    texts = ['{"a":1,"b":[2, 3.50]}', '{"a":-0,"b":[1e5, 7]}', '{"a":01,"b":[1, 2]}', '{"a":1-,"b":[1, 2]}', '{"a":1,"b":[1e999, 2]}', '{"a":"x, 4 ","b":5}', '{"a":"x, 6 ","b":7}', '{"a":1000000000000000000000000000000,"b":1}', '{"a":NaN,"b":1}', "7", " 7 ", "", '{"a":{"b":1},"a.b":2}', '{"a":{"b":3},"a.b":3}']
    for text in texts + texts[::-1]:
        try:
            want = K._by_path(K.strict_json(text))
        except ValueError:
            want = {}
        assert shared.read(text).by_path() == want, text
    assert shared.read(None).by_path() == {}
    docs = [(t, shared.read(t)) for t in texts]
    alone = K._Reader()
    alone.shapes = dict.fromkeys([tuple(K._NUMBER.split(t)[::2]) for t in texts])  # no shape is known, so each is parsed
    for t, x in docs:
        for u, y in docs:
            got, want = ([], [], []), ([], [], [])
            shared.changes(x, y, *got)
            alone.changes(alone.read(t), alone.read(u), *want)
            assert sorted(map(str, zip(*got))) == sorted(map(str, zip(*want))), (t, u)
