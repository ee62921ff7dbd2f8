"""Strict JSON-lines scans and sinks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.contracts import strict_json
from ..operators.metrics import step_regressions
from ..session import ship
from .store import Store

#: Events of a metric log.
METRIC = "event string, step bigint, tokens_seen bigint, train_loss double, learning_rate double, grad_norm double, tokens bigint, elapsed_seconds double, validation_loss double, perplexity double, checkpoint_path string"


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_no, line_no, line) with lines numbered from 1 in each file; an empty file has none.

    Files are read in blocks by as many tasks as there are.  A task numbers its blocks' lines, blocks are
    counted (a few rows), and the lines of earlier blocks are added; so neither a file nor a task has to hold all lines.
    """
    ship(spark)
    store = Store(spark)
    order = spark.createDataFrame([(i, re.sub("^file:/+", "file:/", store.qualified(p))) for i, p in enumerate(paths)], "file_no int, path string")
    if len({r for r in paths}) != len(paths):
        raise ValueError("a file is given twice")
    name = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    text = spark.read.option("lineSep", "\n").text(paths).select(name.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = None, 0
        for b in batches:
            place = []
            for here in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, n = here, n + 1 if here == at else 1
                place.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place, pa.int64())], names=["path", "block", "line", "n"])

    rows = text.mapInArrow(number, "path string, block bigint, line string, n bigint")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    blocks = rows.groupBy("path", "block").agg(F.max("n").alias("_m")).select("path", "block", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_b"))
    return rows.join(blocks, ["path", "block"]).join(F.broadcast(order), "path").select("file_no", (F.col("_b") + F.col("n")).alias("line_no"), "line")


def checked(spark: SparkSession, paths: list[str], schema: str, text: str | None = None, tokens: str | None = None) -> DataFrame:
    """Parsed rows with file_no, line_no and violation: blank, not_json (repeated keys and NaN included), not_object, no_text, bad_tokens."""
    ship(spark)
    want = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            why, clean = [], []
            for line in b.column(2).to_pylist():
                v, out = None, None
                if not line.strip():
                    v = "blank"
                else:
                    try:
                        row = strict_json(line)
                        if not isinstance(row, dict):
                            v = "not_object"
                        elif text and not (isinstance(row.get(text), str) and row[text]):
                            v = "no_text"
                        elif tokens and (isinstance(row.get(tokens), bool) or not isinstance(row.get(tokens), int) or row[tokens] < 0):
                            v = "bad_tokens"
                        else:
                            out = json.dumps(row, ensure_ascii=False)
                    except ValueError:
                        v = "not_json"
                why.append(v)
                clean.append(out)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(why, pa.string()), pa.array(clean, pa.string())], names=["file_no", "line_no", "violation", "row"])

    d = lines(spark, paths).select("file_no", F.col("line_no").cast("int"), "line").mapInArrow(run, "file_no int, line_no int, violation string, row string")
    return d.select("file_no", "line_no", "violation", F.from_json("row", want).alias("r")).select("file_no", "line_no", "violation", "r.*")


def read_strict(spark: SparkSession, paths: list[str], schema: str, text: str | None = "text", tokens: str | None = None) -> DataFrame:
    """Rows of the files in order columns; the first bad line by file and number is the error."""
    d = checked(spark, paths, schema, text, tokens)
    bad = d.where("violation is not null").orderBy("file_no", "line_no").select("file_no", "line_no", "violation").take(1)
    if bad:
        raise ValueError(f"{paths[bad[0][0]]}, line {bad[0][1]}: {bad[0][2]}")
    return d.drop("violation")


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    """A metric log: last line closed, no blank lines, no NaN constants, steps never falling."""
    if Store(spark).last_byte(path) != ord("\n"):
        raise ValueError("the last line is incomplete")
    d = read_strict(spark, [path], METRIC, text="event")
    wrong = step_regressions(d, "line_no", run="file_no").orderBy("line_no").select("step", "highest_before").take(1)
    if wrong:
        raise ValueError(f"step {wrong[0][0]} comes after {wrong[0][1]}")
    return d


def append_event(path: str | Path, event: dict) -> None:
    """Appends one event as a line, flushed; NaN and infinity are refused."""
    line = json.dumps(event, allow_nan=False, sort_keys=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(line + "\n")
        f.flush()


def write_splits(rows: DataFrame, path: str) -> None:
    """One folder per shard and split; the job commit publishes all files or none."""
    rows.write.mode("errorifexists").partitionBy("shard_index", "split").json(path)


def write_sample(rows: DataFrame, path: str, n: int, order: str = "source_ord") -> None:
    """The first n records by order (the sample size is the feature)."""
    rows.orderBy(order).limit(n).coalesce(1).write.mode("errorifexists").json(path)


def read_observed(spark: SparkSession, paths: list[str], schema: str, text: str = "text", tokens: str | None = None) -> tuple[DataFrame, Observation]:
    """Rows as read_strict gives them, and an observation of their number, characters and bytes that fills in the pass that uses them."""
    seen = Observation("jsonl")
    rows = read_strict(spark, paths, schema, text, tokens)
    return rows.observe(seen, F.count(F.lit(1)).alias("records"), F.sum(F.length(text)).alias("characters"), F.sum(F.octet_length(text)).alias("utf8_bytes")), seen
