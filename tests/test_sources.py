import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import clean as C
from siltstone.operators import contracts as K
from siltstone.sources import binary, files, jsonl
from siltstone.operators import tokens as tokens_of
from siltstone.streaming import build
from siltstone.streaming import tokens as token_build
from test_text import SCHEMA, raw, raw_rows


def test_codecs_round_trip_and_detect_damage():
    s = binary.Shard("test", np.array([5, 6, 1, 7, 1]), [3, 2], [b"a" * 32, b"b" * 32])
    tok, idx = binary.encode_shard(s)
    assert len(tok) == 64 + 10 and len(idx) == 128 + 96
    head, ids = binary.decode_tokens(tok)
    assert ids.tolist() == [5, 6, 1, 7, 1] and (head["least"], head["greatest"]) == (1, 7)
    assert [e[:2] for e in binary.decode_index(idx)[1]] == [(0, 3), (3, 2)]
    for bad in (tok + b"x", b"X" + tok[1:], tok[:21] + b"\1" + tok[22:]):
        with pytest.raises(ValueError):
            binary.decode_tokens(bad)
    moved = idx[:176] + (4).to_bytes(8, "little") + idx[184:]
    with pytest.raises(ValueError, match="gap"):
        binary.decode_index(moved)
    with pytest.raises(ValueError):
        binary.decode_index(idx + b"x")


def test_binary_sink_and_scan(spark, tmp_path):
    rows = [("train", 0, 0, [5, 6, 1], "ab" * 32), ("train", 0, 1, [7, 1], "cd" * 32), ("test", 0, 0, [9, 1], "ef" * 32)]
    d = spark.createDataFrame(rows, "split string, shard_index int, doc_ord bigint, tokens array<int>, text_sha256 string").withColumn("token_start", F.lit(0).cast("bigint")).withColumn("document_start", F.lit(0).cast("bigint"))
    info = {r["split"]: r for r in binary.write_shards(d, str(tmp_path)).collect()}
    assert info["train"]["tokens"] == 5 and info["train"]["sha256"] == files.file_digest(tmp_path / "train-00000.bin")
    back = {(r["split"], r["doc_ord"]): r["tokens"] for r in binary.read_documents(spark, str(tmp_path)).collect()}
    assert back == {("train", 0): [5, 6, 1], ("train", 1): [7, 1], ("test", 0): [9, 1]}
    assert binary.read_index(spark, f"{tmp_path}/train*.idx").count() == 2
    want = spark.createDataFrame([("train", 0, 1, 3), ("test", 0, 0, 2), ("train", 0, 5, 0)], "split string, shard_index int, start bigint, n int")
    assert {(r["split"], r["start"]): r["ids"] for r in binary.read_slices(want, str(tmp_path)).collect()} == {("train", 1): [6, 1, 7], ("test", 0): [9, 1], ("train", 5): []}
    with pytest.raises(Exception, match="inside"):
        binary.read_slices(want.withColumn("n", F.lit(9)), str(tmp_path)).collect()


def test_strict_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"text": "x", "n": 1}\n{"text": "y", "n": 2}\n')
    assert jsonl.read_strict(spark, [str(p)], "text string, n bigint", tokens="n").count() == 2
    rows, seen = jsonl.read_observed(spark, [str(p)], "text string, n bigint")
    assert rows.count() == 2 and seen.get == {"records": 2, "characters": 2, "utf8_bytes": 2}
    cases = {"\n": "blank", "[1]\n": "not_object", '{"text": "x", "text": "y"}\n': "not_json", '{"text": "x", "n": NaN}\n': "not_json", '{"text": "", "n": 1}\n': "no_text", '{"text": "x", "n": true}\n': "bad_tokens"}
    for line, why in cases.items():
        p.write_text('{"text": "x", "n": 1}\n' + line)
        with pytest.raises(ValueError, match=f"line 2: {why}"):
            jsonl.read_strict(spark, [str(p)], "text string, n bigint", tokens="n")


def test_metric_log(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    for i in (1, 2, 2):
        jsonl.append_event(p, {"event": "train_update", "step": i, "train_loss": 1.5})
    assert jsonl.read_metric_log(spark, str(p)).count() == 3
    jsonl.append_event(p, {"event": "train_update", "step": 1})
    with pytest.raises(ValueError, match="after"):
        jsonl.read_metric_log(spark, str(p))
    p.write_text('{"event": "x"}')
    with pytest.raises(ValueError, match="incomplete"):
        jsonl.read_metric_log(spark, str(p))
    with pytest.raises(ValueError):
        jsonl.append_event(p, {"loss": float("nan")})


def test_files(tmp_path, monkeypatch):
    assert files.write_json(tmp_path / "a.json", {"b": 1}) and not files.write_json(tmp_path / "a.json", {"b": 1})
    files.publish_new(tmp_path / "n.json", [1])
    with pytest.raises(FileExistsError):
        files.publish_new(tmp_path / "n.json", [2])
    assert json.loads((tmp_path / "n.json").read_text()) == [1]
    assert files.resolve_sources(["a/b.parquet"], "/data") == ["/data/a/b.parquet"]
    monkeypatch.setenv(files.CACHE_VARIABLE, "relative")
    with pytest.raises(ValueError):
        files.resolve_sources(["a.parquet"], "/data")
    for bad in ("/a.parquet", "../a.parquet", "a//b.parquet", "a.json", ""):
        with pytest.raises(ValueError):
            files.check_source_path(bad)


def test_contracts():
    assert K.fingerprint({"a": 1, "b": {"c": 2}}, ("b.c",)) == K.fingerprint({"b": {}, "a": 1})
    assert K.flatten({"a": [1, {"b": None}]}) == [("a[0]", "1", "int"), ("a[1].b", "null", "NoneType")]
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}', "{"):
        with pytest.raises(ValueError):
            K.strict_json(bad)
    assert K.parameter_count(100, 10, 8, 2, 32) == 110 * 8 + 2 * (4 * 64 + 2 * 8 * 32 + 4 * 8 + 32 + 8 + 4 * 8) + 16


def long_rows(n):
    one = raw_rows()[0]
    return [one | {"source_ord": i, "id": f"d{i}", "text": one["text"] + f" number {i % 8}"} for i in range(n)]


def test_build_publishes_once_and_verifies(spark, tmp_path):
    rows = raw(spark, long_rows(12))
    out = str(tmp_path / "corpus")
    cfg = C.CleanConfig()
    m = build.build_corpus(rows, out, cfg, 500, 200)
    assert m["status"] == "complete" and m["kept"] == 5 and m["input"] == 5 and len(m["shards"]) == 3
    before = sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "corpus").rglob("*"))
    assert build.build_corpus(rows, out, cfg, 500, 200) == m
    assert before == sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "corpus").rglob("*"))
    with pytest.raises(RuntimeError, match="another"):
        build.build_corpus(rows, out, cfg, 600, 200)
    assert build.build_corpus(rows, str(tmp_path / "all"), cfg, 10**6, 300)["status"] == "source_exhausted"
    assert build.build_corpus(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), cfg, 10, 10)["kept"] == 0


def test_stream_resumes_to_the_same_records(spark, tmp_path):
    src = tmp_path / "src"
    for i in range(3):
        raw(spark, long_rows(12)[i * 4 : i * 4 + 4]).coalesce(1).write.mode("append").parquet(str(src))
    cfg = C.CleanConfig()
    part = build.stream_corpus(spark, str(src), str(tmp_path / "a"), cfg, batches=1)
    assert part["committed"] == 1
    build.stream_corpus(spark, str(src), str(tmp_path / "a"), cfg)
    build.stream_corpus(spark, str(src), str(tmp_path / "b"), cfg)
    get = lambda x: sorted((r["id"], r["reason"] or "") for r in spark.read.parquet(f"{tmp_path}/{x}/records").collect())
    assert get("a") == get("b") and sum(r[1] == "" for r in get("a")) == 8
    with pytest.raises(RuntimeError):
        build.stream_corpus(spark, str(src), str(tmp_path / "a"), C.CleanConfig(seed=7))


def batch_files(spark, folder, rows, per=4):
    for i in range(0, len(rows), per):
        raw(spark, rows[i : i + per]).coalesce(1).write.mode("append").parquet(str(folder))
    names = sorted(p for p in folder.glob("*.parquet"))
    for n, p in enumerate(sorted(names, key=lambda p: spark.read.parquet(str(p)).agg(F.min("source_ord")).first()[0])):
        target = folder / f"part-{n:03d}.parquet"
        p.rename(target)
        os.utime(target, (1_700_000_000 + n, 1_700_000_000 + n))  # files are taken in order of age


def test_stream_stops_at_its_token_target(spark, tmp_path):
    rows = long_rows(12)
    rows[2]["text"], rows[3]["language"] = rows[0]["text"], "fr"  # a copy, and another language
    batch_files(spark, tmp_path / "src", rows, 3)
    cfg = C.CleanConfig()
    run = lambda out, **k: build.stream_corpus(spark, str(tmp_path / "src"), str(tmp_path / out), cfg, target=500, shard_target=200, **k)
    done = run("a")
    assert (done["status"], done["input"], done["kept"], done["tokens"]) == ("complete", 7, 5, 500)
    rec = spark.read.parquet(str(tmp_path / "a" / "records"))
    got = {r["source_ord"]: (r["reason"], r["shard_index"]) for r in rec.collect()}
    assert {o: r for o, (r, _) in got.items()} == {0: None, 1: None, 2: "exact_duplicate", 3: "non_english", 4: None, 5: None, 6: None}
    assert sorted({s for _, s in got.values()}) == list(range(done["shards"]))
    before = sorted((p, p.stat().st_mtime_ns) for p in (tmp_path / "a").rglob("*"))
    assert run("a") == done and before == sorted((p, p.stat().st_mtime_ns) for p in (tmp_path / "a").rglob("*"))  # a finished stream changes no bytes
    assert run("b", batches=1)["status"] == "running" and run("b", batches=1)["committed"] == 2
    (tmp_path / "b" / "records" / "batch=9").mkdir()  # an orphan of a batch that was not registered
    assert run("b") == done and not (tmp_path / "b" / "records" / "batch=9").exists()
    with pytest.raises(RuntimeError, match="another configuration"):
        build.stream_corpus(spark, str(tmp_path / "src"), str(tmp_path / "a"), cfg, target=600, shard_target=200)


def test_stream_refuses_a_source_that_changed(spark, tmp_path):
    batch_files(spark, tmp_path / "src", long_rows(8))
    cfg = C.CleanConfig()
    run = lambda: build.stream_corpus(spark, str(tmp_path / "src"), str(tmp_path / "out"), cfg)
    assert run()["status"] == "source_exhausted"
    first = sorted((tmp_path / "src").glob("*.parquet"))[0]
    data = first.read_bytes()
    first.write_bytes(data + b"x")
    with pytest.raises(RuntimeError, match="not the file"):
        run()
    first.unlink()
    with pytest.raises(RuntimeError, match="ends before"):
        run()
    first.write_bytes(data)
    assert run()["committed"] == 2
    import shutil

    shutil.rmtree(tmp_path / "out" / "digests" / "batch=0")
    with pytest.raises(RuntimeError, match="registered"):
        run()


def token_rows(spark):
    texts = {"train": ["a" * 400, "b" * 400], "validation": ["c" * 600], "test": ["d" * 700]}
    rows = [(s, i, t) for s, ts in texts.items() for i, t in enumerate(ts)]
    d = spark.createDataFrame(rows, "split string, place bigint, text string")
    return d.select("split", "place", tokens_of.code_point_ids(F.col("text")).alias("tokens"), F.sha2("text", 256).alias("text_sha256")).withColumn("n_tokens", F.size("tokens"))


def test_token_build_resumes_and_is_idempotent(spark, tmp_path):
    docs, who = token_rows(spark), {"source": "s1", "tokenizer": "t1"}
    build_it = lambda out, **k: token_build.build_tokens(docs, str(tmp_path / out), 514, k.pop("identity", who), **k)
    m = build_it("a")
    assert m["splits"] == {"train": {"documents": 2, "tokens": 802}, "validation": {"documents": 1, "tokens": 601}, "test": {"documents": 1, "tokens": 701}}
    assert [s["name"] for s in m["shards"]] == ["train-00000", "train-00001", "validation-00000", "test-00000"] and sum(s["bytes"] - 64 for s in m["shards"]) == 4208
    files_of = lambda x: sorted((p.name, p.read_bytes()) for p in (tmp_path / x).iterdir() if not p.name.endswith(".crc"))
    before = sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "a").iterdir())
    assert build_it("a") == m and before == sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "a").iterdir())
    assert build_it("b", splits=1)["splits"] == ["train"]
    stage = tmp_path / "b.staging"
    (stage / ".x.part").write_bytes(b"1")
    (stage / "test-00007.bin").write_bytes(b"1")  # never registered
    assert build_it("b") == m and files_of("a") == files_of("b")
    build_it("c", splits=2)
    with pytest.raises(RuntimeError, match="another configuration"):
        build_it("c", identity=who | {"tokenizer": "t2"})
    shard = tmp_path / "c.staging" / "train-00000.bin"
    shard.write_bytes(shard.read_bytes() + b"xx")
    with pytest.raises(RuntimeError, match="not as it was"):
        build_it("c")
    bad = tmp_path / "a" / "test-00000.bin"
    bad.write_bytes(bad.read_bytes()[:-2] + b"\7\0")
    (tmp_path / "a" / ".test-00000.bin.crc").unlink(missing_ok=True)
    with pytest.raises(Exception):
        build_it("a")


def test_manifest_has_its_files(spark, tmp_path):
    m = build.build_corpus(raw(spark, long_rows(12)), str(tmp_path / "corpus"), C.CleanConfig(), 10**6, 300)
    assert sum(f["records"] for s in m["shards"] for f in s["files"]) == m["kept"] and all(len(f["sha256"]) == 64 for s in m["shards"] for f in s["files"])


def test_lines_of_many_blocks(spark, tmp_path):
    one, two = tmp_path / "a+b c.jsonl", tmp_path / "two.jsonl"
    one.write_text("".join(f'{{"text": "line {i}", "n": {i}}}\n' for i in range(5000)))
    two.write_text('{"text": "x\u2028y", "n": 1}')
    (tmp_path / "empty.jsonl").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = jsonl.lines(spark, [str(one), str(two), str(tmp_path / "empty.jsonl")]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r["file_no"], r["line_no"]) for r in got} == {(0, i + 1) for i in range(5000)} | {(1, 1)}
    assert all(r["line"] == f'{{"text": "line {r["line_no"] - 1}", "n": {r["line_no"] - 1}}}' for r in got if r["file_no"] == 0)


def test_sources_are_read_in_order(spark, tmp_path):
    for n in range(2):
        spark.range(n * 10, n * 10 + 5).coalesce(1).write.parquet(str(tmp_path / f"d{n}"))
    places = [str(next((tmp_path / f"d{n}").glob("*.parquet"))) for n in (1, 0)]
    got = [r["id"] for r in files.read_sources(spark, places, ["id"]).orderBy("source_ord").collect()]
    assert got == [10, 11, 12, 13, 14, 0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        files.read_sources(spark, [], ["id"])
    assert files.pinned_sources(["a/b.parquet"], "s3://x/", "ab" * 20) == [f"s3://x/{'ab' * 20}/a/b.parquet"]
    with pytest.raises(ValueError):
        files.pinned_sources(["a.parquet"], "s3://x", "main")
    with pytest.raises(ValueError):
        files.resolve_sources(["a.parquet", "a.parquet"], "/data")


def test_split_files_are_found_and_written(spark, tmp_path):
    d = spark.createDataFrame([(i % 2, s, f"t{i}") for i in range(6) for s in ("train", "validation", "test")], "shard_index int, split string, text string")
    jsonl.write_splits(d, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 18
    with pytest.raises(Exception, match="exist"):
        jsonl.write_splits(d, str(tmp_path / "out"))
    for i in range(2):
        for s in ("train", "validation", "test"):
            p = tmp_path / "found" / f"shard-{i:05d}" / f"{s}.jsonl"
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text("{}\n")
    assert [p.parent.name for p in files.discover_split_files(tmp_path / "found", shards=2)["test"]] == ["shard-00000", "shard-00001"]
    with pytest.raises(ValueError):
        files.discover_split_files(tmp_path / "found", shards=3)
    (tmp_path / "found" / "shard-00001" / "test.jsonl").unlink()
    with pytest.raises(FileNotFoundError):
        files.discover_split_files(tmp_path / "found")


def test_file_table(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    r = files.file_table(spark, str(tmp_path / "*.bin")).first()
    assert (r["bytes"], r["sha256"]) == (3, files.file_digest(tmp_path / "a.bin"))


def test_vocabulary_check():
    from siltstone.operators import bpe

    c = bpe.vocabulary_check(bpe.vocabulary_file())
    assert c["contiguous"] and c["sample_in_range"] and c["size"] > 50_000


def test_configurations_refuse_repeated_keys():
    assert K.load_document('{"a": 1}') == {"a": 1}
    with pytest.raises(ValueError):
        K.load_document('{"a": 1, "a": 2}')
    try:
        import yaml  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            K.load_document("a: 1", yaml=True)
        return
    assert K.load_document("a: {b: [1, 2]}", yaml=True) == {"a": {"b": [1, 2]}}
    with pytest.raises(ValueError):
        K.load_document("a: 1\na: 2", yaml=True)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from siltstone import session

    conf = SimpleNamespace(get=lambda *a: None)
    with pytest.raises(RuntimeError):
        session.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn")))
    conf.get = lambda *a: "hdfs://x/shared/"
    assert session.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn"))) == "hdfs://x/shared"
