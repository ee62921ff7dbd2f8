"""Splits, near-duplicates and cross-split overlaps against brute force."""

import random
from itertools import combinations

import pytest

from siltstone.llm import components, crosssplit, neardup, overlap, shingles, sites, splits

SUFFIXES = frozenset({"example", "test", "edu.example", "co.test"})


def test_site_forms():
    same = ["http://WWW.Étude.example/x", "https://xn--tude-9oa.example:443/", " étude.example. ", "//a.étude.example/p?q=a@b.test", "u:p@étude.example/z"]
    assert {sites.site_of(u, SUFFIXES) for u in same} == {"étude.example"}
    none = [None, "", "  ", "n/a", "unknown", "about:blank", "mailto:a@b.example", "http:///x", "/lessons/x", "http://example/", "http://a.other/", "http://edu.example/x"]
    got = [sites.site_of(u, SUFFIXES) for u in none]
    assert got[:-1] == [None] * (len(none) - 1) and got[-1] == "edu.example"
    assert sites.site_of("http://x.y.edu.example/", SUFFIXES) == "y.edu.example"


def least_reached(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 200)]
    df = spark.createDataFrame([*pairs, (7, 7), (None, 3), *pairs[:5]], "u bigint, v bigint")
    got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    assert got == least_reached([p for p in pairs if p[0] != p[1]])
    assert components.connected_components(df.limit(0)).count() == 0


def test_splits_keep_groups_and_targets(spark):
    rng = random.Random(3)
    rows = [(i, None if i % 50 == 0 else "hot" if i % 3 == 0 else f"s{rng.randrange(900)}", None if i % 2 else f"o{rng.randrange(600)}" if i % 3 else "oh", i) for i in range(4000)]
    df = spark.createDataFrame(rows, "id bigint, site string, owner string, component bigint").drop("component")
    comp = splits.entity_components(df, "id", ["site", "owner"])
    got = {r["id"]: r["component"] for r in comp.collect()}
    want = least_reached([(("s", s), ("o", o)) for _, s, o, _ in rows if s and o])
    name = lambda s, o: want.get(("s", s), ("s", s)) if s else want.get(("o", o), ("o", o)) if o else None
    by: dict = {}
    for i, s, o, _ in rows:
        n = name(s, o)
        assert (n is None) == (got[i] is None)
        if n is not None:
            by.setdefault(n, set()).add(got[i])
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)

    lone = spark.createDataFrame([(i, 5 if i < 1000 else 10 + i % 700) for i in range(3000)], "id bigint, component bigint")
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, target_ratio double")
    out = splits.grouped_splits(lone, "id", targets).collect()
    assert len(out) == 3000
    one: dict = {}
    for r in out:
        one.setdefault(r["component"], set()).add(r["split"])
    assert all(len(v) == 1 for v in one.values())
    for s, t in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert abs(sum(r["split"] == s for r in out) / 3000 - t) < 0.01
    assert splits.grouped_splits(lone.limit(0), "id", targets).count() == 0
    # a corpus that grew: what was placed stays, and the shares are still met
    more = spark.createDataFrame([(i, 5 if i < 1000 else 10 + i % 900) for i in range(6000)], "id bigint, component bigint")
    grown = {r["id"]: r for r in splits.grouped_splits(more, "id", targets, splits.grouped_splits(lone, "id", targets)).collect()}
    moved = {r["component"] for r in out if grown[r["id"]]["split"] != r["split"]}
    joined = {10 + i % 900 for i in range(1000, 3000)} | {10 + i % 700 for i in range(1000, 3000)}
    assert moved <= joined and grown[0]["split"] == next(r["split"] for r in out if r["id"] == 0)
    each: dict = {}
    for r in grown.values():
        each.setdefault(r["component"], set()).add(r["split"])
    assert all(len(v) == 1 for v in each.values()) and abs(sum(r["split"] == "train" for r in grown.values()) / 6000 - 0.8) < 0.05
    same = spark.createDataFrame([(r["id"], r["component"]) for r in out], "id bigint, component bigint")
    again = {r["id"]: r["split"] for r in splits.grouped_splits(same, "id", targets, splits.grouped_splits(lone, "id", targets)).collect()}
    assert again == {r["id"]: r["split"] for r in out}
    rec = spark.createDataFrame([(i, "train" if i % 2 else "test") for i in range(3000)], "id bigint, split string")
    hit = {r["id"] for r in splits.straddling(lone, rec, "id").collect()}
    assert set(range(1000)) <= hit


def corpus(rng, n=260):
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(n):
        k = rng.random()
        if texts and k < 0.5:
            w = rng.choice(texts).split()
            for _ in range(rng.randrange(0, 6)):
                p = rng.randrange(len(w) + 1)
                w[p : p + rng.randrange(0, 2)] = [rng.choice(words)] * rng.randrange(0, 2)
            texts.append(" ".join(w) or "x")
        elif k < 0.6:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))))
        else:
            texts.append("the end of the day is near " * (k < 0.8) + " ".join(rng.choice(words) for _ in range(rng.randrange(20, 90))))
    return texts


def sets(t, k):
    w = shingles.words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def similar(a, b):
    return bool(a and b) and len(a & b) / len(a | b) >= 0.6


def test_near_duplicates_match_brute_force(spark):
    texts = corpus(random.Random(8))
    rows = [(i, t, "clash", 1, 2.0, "x") for i, t in enumerate(texts)] + [(900, None, None, None, None, None), (901, "", "", 0, 0.0, ""), (902, " \n", "", 0, 0.0, ""), (903, "two words", "", 0, 0.0, "")]
    rows += [(910 + i, texts[0].upper() + " !", "", 0, 0.0, "") for i in range(3)] + [(920, "long " + "word stream of many parts " * 20000, "", 0, 0.0, "")]
    df = spark.createDataFrame(rows, "source_ord bigint, text string, id string, a int, similarity double, rep string")
    got = {r["id"]: r for r in neardup.near_duplicate_groups(df, k=3, threshold=0.6).collect()}
    s = {i: sets(t, 3) for i, t, *_ in rows if t}
    want = least_reached([(i, j) for i, j in combinations(sorted(s), 2) if similar(s[i], s[j])])
    assert {i: r["first"] for i, r in got.items()} == {i: want.get(i, i) for i in s if s[i]}
    assert got[0]["rep"] == got[911]["rep"] and not {900, 901, 902, 903} & set(got)
    assert neardup.near_duplicate_groups(df.limit(0), k=3, threshold=0.6).count() == 0
    _, links = neardup.near_duplicates(df.where("source_ord < 100"), k=3, threshold=0.6)
    assert all(r["a"] < r["b"] for r in links.collect())


def test_cross_split_pairs_match_brute_force(spark):
    texts = corpus(random.Random(9), 220)
    label = ["train", "train", "validation", "test", "other"]
    rows = [(i, t, label[i % 5], "clash", 0) for i, t in enumerate(texts)] + [(800, None, "train", "", 0), (801, "", "test", "", 0), (802, texts[0], None, "", 0), (803, texts[0], "test", "", 0), (804, texts[0], "test", "", 0)]
    df = spark.createDataFrame(rows, "record_no bigint, text string, split string, ck string, id int")
    got = crosssplit.cross_split_pairs(df, k=3, threshold=0.6).collect()
    s = {i: (sets(t, 3), sp) for i, t, sp, *_ in rows if t}
    want = {(i, j) for i, (a, x) in s.items() for j, (b, y) in s.items() if x == "train" and y in ("validation", "test") and similar(a, b)}
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)
    assert all(0 < r["coverage_a"] <= 1 and 0 < r["coverage_b"] <= 1 for r in got)
    assert all(r["coverage_a"] == 1 for r in got if texts[r["a"]] == dict((i, t) for i, t, *_ in rows)[r["b"]])
    assert crosssplit.cross_split_pairs(df.limit(0), k=3, threshold=0.6).count() == 0


def test_long_lists_are_paired_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(overlap, "BLOCK", 40)
    n = 130
    post = spark.createDataFrame([(1 if i < 120 else 2, i, i if i < 50 else 7, bytes([i % 2]) * 4) for i in range(n)], overlap.POSTING)
    got = {(r["a"], r["b"]) for r in overlap.join_postings(post, 4, 8).collect()}
    group = lambda i: i if i < 50 else 7
    want = {(i, j) for i, j in combinations(range(n), 2) if i % 2 == j % 2 and (i < 120) == (j < 120) and group(i) != group(j)}
    assert got == want


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 20)
    monkeypatch.setattr(overlap, "BLOCK", 32)
    rng = random.Random(12)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(150):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(120)] = f"x{rng.randrange(999)}"
        texts.append(" ".join(w) if i % 3 else " ".join(f"r{rng.randrange(400)}" for _ in range(60)))
    half = base[:90] + [f"h{i}" for i in range(30)]  # linked to some members only
    texts += [" ".join(half)] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "source_ord bigint, text string")
    got = {r["id"]: r["first"] for r in neardup.near_duplicate_groups(df, k=3, threshold=0.6).collect()}
    s = {i: sets(t, 3) for i, t in enumerate(texts)}
    want = least_reached([(i, j) for i, j in combinations(sorted(s), 2) if similar(s[i], s[j])])
    assert got == {i: want.get(i, i) for i in s}


def test_frequent_elements_lose_no_pair(spark):
    rng = random.Random(2)
    docs = [(i, i, sorted({rng.randrange(12) for _ in range(6)} | {1000 + rng.randrange(60) for _ in range(3)}), 4, b"\0\0") for i in range(150)]
    df = spark.createDataFrame(docs, "id bigint, grp bigint, elems array<bigint>, need int, sig binary")
    got = {(r["a"], r["b"]) for r in overlap.join_postings(overlap.postings(df, light=3), 2, 4).collect()}
    want = {(a[0], b[0]) for a, b in combinations(docs, 2) if len(set(a[2]) & set(b[2])) >= 4}
    assert want <= got


def test_chain_is_collinear():
    out = crosssplit.chain([(0, 10), (5, 11), (9, 12), (300, 13)], {10: [2], 11: [7], 12: [11], 13: [1]})
    assert sorted(out) == [(0, 9, 2, 11), (300, 300, 1, 1)]
    many = [(10 * i + j, j) for i in range(12) for j in range(3)]  # a line that stands twelve times in both texts
    assert crosssplit.chain(many, {j: [10 * i + j + 4 for i in range(12)] for j in range(3)}) == [(0, 112, 4, 116)]
    lone = [(0, 1), (20, 1), (40, 1), (60, 2)]  # its last copy is the one that goes on
    assert (0, 60, 100, 160) in crosssplit.chain(lone, {1: [0, 100, 120, 140], 2: [160]})


def test_coverage_of_repeated_lines():
    import numpy as np

    rng = random.Random(31)
    hashed = lambda t: shingles.word_hashes([t])[0]
    line = "share this page with a friend today"
    body = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(9)) for _ in range(14)]
    text = " ".join(f"{line} {x}" for x in body)
    a = hashed(text)
    assert crosssplit.covered(a, a, 3, crosssplit.WINDOW, crosssplit.SHORT) == 1.0
    later = hashed(" ".join(f"{line} {x}" for x in body[7:]))  # the second half alone: its lines are copies eight and on of a's
    assert crosssplit.covered(later, a, 3, crosssplit.WINDOW, crosssplit.SHORT) == 1.0
    gone = hashed(" ".join(f"{line} {x if i % 2 else ' '.join(f'z{rng.randrange(10**6)}' for _ in range(9))}" for i, x in enumerate(body)))
    got = crosssplit.covered(gone, a, 3, 1, 0)
    assert abs(got - np.isin(gone, a).mean()) < 0.02
    assert crosssplit.covered(a[:0], a, 3, 12, 24) == 0.0 and crosssplit.covered(hashed("x y z q"), a, 3, 12, 24) == 0.0
    same = hashed("word " * 3000)
    assert crosssplit.covered(same, same, 3, 12, 24) == 1.0


@pytest.mark.parametrize("w", [1, 3, 8])
def test_winnow_takes_the_least_of_each_window(w):
    import numpy as np

    rng = np.random.default_rng(1)
    s, off = rng.integers(0, 50, 60).astype(np.uint64), np.array([0, 5, 5, 40, 60])
    v, place, o = shingles.winnow(s, off, w, 2)
    for d in range(4):
        one, chosen = s[off[d] : off[d + 1]], set(place[o[d] : o[d + 1]].tolist())
        for i in range(len(one) - w + 1):
            assert i + int(one[i : i + w].argmin()) in chosen


def edited(rng, base, edits):
    w = list(base)
    for p in rng.sample(range(len(w)), edits):
        w[p] = f"e{rng.randrange(10**6)}"
    return w


def test_cross_split_pairs_of_all_lengths_are_found(spark):
    rng = random.Random(21)
    rows, near = [], []
    for n, edits in ((25, 2), (30, 2), (36, 3), (40, 3), (50, 4), (60, 5)):
        for _ in range(150):
            a = [f"v{rng.randrange(5000)}" for _ in range(n + 2)]
            near.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(a), "train"), (len(rows) + 1, " ".join(edited(rng, a, edits)), "test")]
    df = spark.createDataFrame(rows, "record_no bigint, text string, split string")
    got = {(r["a"], r["b"]) for r in crosssplit.cross_split_pairs(df, k=3, threshold=0.6).collect()}
    s = {i: sets(t, 3) for i, t, _ in rows}
    assert got == {(i, j) for i, j in near if similar(s[i], s[j])}


def test_cross_split_pairs_of_frequent_shingles_are_found(spark):
    rng = random.Random(22)
    base = [f"h{i}" for i in range(28)]  # every shared shingle is in hundreds of documents
    rows = [(i, " ".join(edited(rng, base, 1)), "train" if i % 2 else "test") for i in range(600)]
    df = spark.createDataFrame(rows, "record_no bigint, text string, split string")
    got = {(r["a"], r["b"]) for r in crosssplit.cross_split_pairs(df, k=3, threshold=0.6).collect()}
    s = [sets(t, 3) for _, t, _ in rows]
    assert got == {(i, j) for i in range(1, 600, 2) for j in range(0, 600, 2) if similar(s[i], s[j])}


def test_prefixes_meet(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    none = np.zeros(1 << crosssplit.SEEN_BITS - 3, np.uint8) - np.uint8(1), np.zeros(1 << crosssplit.COUNT_BITS, np.uint32)
    for n in range(1, 60):
        pool = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        a, b = (np.sort(np.concatenate([pool[: (m := -(-3 * n // 4))], x[: n - m]])) for x in (pool[n:], pool[n + n // 2 :]))
        if len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.6:
            v, o = crosssplit.prefixes(np.concatenate([a, b]), np.array([0, n, 2 * n]), 0.6, *none)
            assert len(np.intersect1d(v[: o[1]], v[o[1] :]))


def test_links_inside_large_groups_are_counted(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 20)
    monkeypatch.setattr(neardup, "SIDE", 50)
    rng = random.Random(13)
    base = [f"b{i}" for i in range(100)]
    texts = [" ".join(edited(rng, base, i % 12)) for i in range(700)] + [" ".join(base[:85] + [f"h{i}" for i in range(20)]), " ".join(base)]
    df = spark.createDataFrame(list(enumerate(texts)), "source_ord bigint, text string")
    s = {i: sets(t, 3) for i, t in enumerate(texts)}
    rep: dict = {}
    for i in s:
        rep.setdefault(frozenset(s[i]), i)
    want = {(i, j) for i, j in combinations(sorted(rep.values()), 2) if similar(s[i], s[j])}
    links = neardup.near_duplicates(df, k=3, threshold=0.6)[1].collect()
    assert {(r["a"], r["b"]) for r in links} == want and len(links) == len(want)
    got = {r["id"]: r["links"] for r in neardup.near_duplicate_groups(df, k=3, threshold=0.6).collect()}
    assert got == {i: sum(rep[frozenset(s[i])] in p for p in want) for i in s}
