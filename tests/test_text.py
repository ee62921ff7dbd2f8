import hashlib
import random
import re
import unicodedata

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import clean as C

WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"


def spec(t):
    t = unicodedata.normalize("NFC", t).replace("\r\n", "\n").replace("\r", "\n")
    lines = [re.sub(r"\s+", " ", x).strip() for x in t.split("\n")]
    return re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip()


def test_golden_string(spark):
    raw = "  Café\tlesson\r\n\r\n\r\nSecond   paragraph  "
    got = spark.createDataFrame([(raw,)], "t string").select(T.normalize_text(F.col("t"))).first()[0]
    assert got == "Café lesson\n\nSecond paragraph"


def test_random_strings_match_the_definition(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(WS + "ab́e") for _ in range(rng.randrange(0, 40)))) for i in range(800)] + [(900, ""), (901, None)]
    got = dict(spark.createDataFrame(rows, "i int, t string").select("i", T.normalize_text(F.col("t"))).collect())
    for i, t in rows:
        assert got[i] == (None if t is None else spec(t)), repr(t)


def test_split_fraction_matches_python_and_ratios(spark):
    rows = [(hashlib.sha256(str(i).encode()).hexdigest(),) for i in range(3000)]
    out = spark.createDataFrame(rows, "h string").select("h", T.fraction(42, F.col("h")).alias("u"), T.split_label(42, F.col("h"), 0.98, 0.01).alias("s")).collect()
    for r in out[:200]:
        assert r["u"] == int(hashlib.sha256(f"42:{r['h']}".encode()).hexdigest()[:16], 16) / 2**64
    share = sum(r["s"] == "train" for r in out) / len(out)
    assert abs(share - 0.98) < 0.01


def raw_rows():
    base = "A whole sentence about rivers and hills that is long enough. " * 5
    ok = lambda i, **k: {"source_ord": i, "id": f"d{i}", "text": base + str(i), "url": None, "language": "en", "language_score": 0.95, "int_score": 3, "token_count": 100} | k
    return [ok(0), ok(1, text=base + "0"), ok(2, text=" \n"), ok(3, text="short"), ok(4, language="fr"), ok(5, language_score=0.64), ok(6, int_score=2), ok(7, token_count=0), ok(8), ok(9, text=None), ok(10, language_score=float("nan")), ok(11, language=None)]


SCHEMA = "source_ord bigint, id string, text string, url string, language string, language_score double, int_score int, token_count bigint"


def raw(spark, rows=None):
    rows = raw_rows() if rows is None else rows
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)


def test_one_case_per_reason(spark):
    got = {r["source_ord"]: r["reason"] for r in C.corpus(raw(spark)).collect()}
    r = C.REASONS
    assert got == {0: None, 1: r[6], 2: r[0], 3: r[1], 4: r[2], 5: r[3], 6: r[4], 7: r[5], 8: None, 9: r[0], 10: r[3], 11: r[2]}


def test_counters_show_zeros_and_conserve(spark):
    rows = C.corpus(raw(spark))
    n = {r["reason"]: r["records"] for r in C.removal_counts(rows).collect()}
    assert n["kept"] == 2 and n["missing_or_empty_text"] == 2 and sum(n.values()) == 12
    c = C.conservation(rows).first()
    assert c["rows_conserved"] and c["splits_conserved"]
    empty = C.corpus(spark.createDataFrame([], SCHEMA))
    assert C.retention(empty).first()["retention_rate"] == 0.0
    assert all(r["records"] == 0 for r in C.removal_counts(empty).collect())


def test_bad_settings_are_refused():
    import pytest

    for bad in ({"min_characters": 0}, {"min_language_score": 1.1}, {"train": 0.99, "validation": 0.01}):
        with pytest.raises(ValueError):
            C.CleanConfig(**bad)


def test_invalid_tokens_claim_no_digest(spark):
    rows = raw_rows()[:2]
    rows[0]["token_count"] = None
    got = {r["source_ord"]: r["reason"] for r in C.corpus(raw(spark, rows)).collect()}
    assert got == {0: C.REASONS[5], 1: None}


def test_lists_hash_repeat_and_diverge(spark):
    d = spark.createDataFrame([([1, 2, 3], [1, 2, 4]), ([1, 2], [1, 2, 3]), ([5], [5]), ([], [])], "a array<int>, b array<int>")
    got = d.select(T.first_divergence(F.col("a"), F.col("b")).alias("d"), T.repeat_to(F.col("a"), 5).alias("r"), T.ids_digest(F.col("a")).alias("h")).collect()
    assert [r["d"] for r in got] == [2, 2, None, None]
    assert [r["r"] for r in got] == [[1, 2, 3, 1, 2], [1, 2, 1, 2, 1], [5] * 5, []]
    assert got[0]["h"] == hashlib.sha256(b"[1,2,3]").hexdigest()
