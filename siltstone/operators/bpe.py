"""Byte-level BPE with a public vocabulary: encoding, decoding, checks, pair counts.  No tokenizer is trained here."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

_loaded: dict = {}


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _loaded[path] = t
    return _loaded[path]


def vocabulary_check(path: str) -> dict:
    """Size of the vocabulary, whether ids are 0 .. size - 1, and the sample's greatest id."""
    t = tokenizer(path)
    ids = sorted(t.get_vocab().values())
    return {"size": len(ids), "contiguous": ids == list(range(len(ids))), "sample_in_range": max(t.encode("Sample check: café 1").ids) < len(ids)}


def round_trip(docs: DataFrame, key: str, text: str, end_id: int, path: str | None = None) -> DataFrame:
    """(key, n_tokens, round_trip): ids of the composed text with the end id, and whether decoding gives the composed text back.  Null texts have null."""
    ship(docs.sparkSession)
    place = path or vocabulary_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(place)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = [None if x is None else unicodedata.normalize("NFC", x) for x in part.column(1).to_pylist()]
                ids = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
                back = t.decode_batch(ids, skip_special_tokens=False)
                n = [None if x is None else len(i) + 1 for x, i in zip(texts, ids)]
                same = [None if x is None else x == y for x, y in zip(texts, back)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int32()), pa.array(same, pa.bool_())], names=[key, "n_tokens", "round_trip"])

    return docs.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` bigint, n_tokens int, round_trip boolean")


def pair_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(left, right, n): adjacent characters within words (runs of letters of any script), weighted by word counts: one round's statistics of pair merging.

    Words are counted first with map-side partial sums, so pairs are made from distinct words only.
    """
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit("\\p{L}+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c")).where("length(w) > 1")
    pairs = words.select("c", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("i"), "w").select("c", F.substring("w", F.col("i"), F.lit(1)).alias("left"), F.substring("w", F.col("i") + 1, F.lit(1)).alias("right"))
    return pairs.groupBy("left", "right").agg(F.sum("c").alias("n"))
