"""Generation statistics over whole texts against brute force."""

import math
import random
from collections import Counter

from siltstone.operators import generation as G
from siltstone.plans.catalogue import QUERIES


def longest(t):
    n = 0
    while len({tuple(t[i : i + n + 1]) for i in range(len(t) - n)}) < len(t) - n:
        n += 1
    return n


def test_longest_repeat_of_whole_lists(spark):
    rng = random.Random(4)
    lists = [[rng.randrange(k) for _ in range(n)] for n in (0, 1, 2, 3, 7, 60, 200) for k in (1, 2, 50)] + [[*range(100), *range(60), *range(500, 540)]]
    df = spark.createDataFrame(list(enumerate(lists)), "record_no bigint, tokens array<int>")
    got = {r["record_no"]: r["longest"] for r in G.longest_repeats(df, "record_no", "tokens").collect()}
    assert got == {i: longest(t) for i, t in enumerate(lists)} and got[len(lists) - 1] == 60


def test_queries_read_whole_texts(spark, sf):
    rows = [r for r in spark.read.parquet(f"{sf}/clean_records.parquet").collect() if r["text"] is not None]
    want = {r["record_no"]: longest([100 + ord(c) % 97 for c in r["text"]] + [1]) for r in rows if r["split"] is not None}
    assert {r["record_no"]: r["longest"] for r in QUERIES["generation_longest_repeat"](spark, sf).collect()} == want
    got = {r["record_no"]: r for r in QUERIES["generation_diversity"](spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = [len(w) * 31 + ord((w + "a")[0]) % 7 for w in r["text"].lower().split(" ")]
        c, g = Counter(ids), list(zip(ids, ids[1:]))
        x = got[r["record_no"]]
        assert abs(x["entropy"] - abs(math.log(len(ids)) - sum(v * math.log(v) for v in c.values()) / len(ids))) < 2e-6
        assert abs(x["distinct_tokens"] - len(c) / len(ids)) < 1e-7 and (not g or abs(x["distinct_ngrams"] - len(set(g)) / len(g)) < 1e-7)
