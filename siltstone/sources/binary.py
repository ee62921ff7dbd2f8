"""Binary token shards and document indexes: codecs, sink and scan."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .store import file_system, write_whole

# Fixed values of the format: magics, layouts, codes.
TOKEN_MAGIC, INDEX_MAGIC, VERSION = b"SGPTTOK1", b"SGPTIDX1", 1
TOKEN_LAYOUT = struct.Struct("<8sHHBBHIB3xQQQIII4x")
INDEX_LAYOUT = struct.Struct("<8sHHHBBQQQQ32sQI36x")
ENTRY_LAYOUT = struct.Struct("<QQ32s")
SPLIT_CODE = {"train": 0, "validation": 1, "test": 2}
UINT16, LITTLE, OFFSET_FROM_SHARD, LENGTH_WITH_END, APPEND_END = 1, 1, 1, 1, 1


@dataclass(frozen=True)
class Shard:
    split: str
    tokens: np.ndarray
    lengths: list[int]
    digests: list[bytes]
    token_start: int = 0
    document_start: int = 0
    vocabulary: int = 16_384
    end_id: int = 1


def encode_shard(s: Shard) -> tuple[bytes, bytes]:
    """Bytes of the token file and of its index."""
    t = np.asarray(s.tokens)
    if not len(t) or not s.lengths or sum(s.lengths) != len(t) or min(s.lengths) < 1:
        raise ValueError("lengths don't cover the tokens")
    if t.min() < 0 or t.max() >= min(s.vocabulary, 1 << 16):
        raise ValueError("an id is out of range")
    if (t[np.cumsum(s.lengths) - 1] != s.end_id).any():
        raise ValueError("a document doesn't end with the end id")
    body = t.astype("<u2").tobytes()
    head = TOKEN_LAYOUT.pack(TOKEN_MAGIC, VERSION, TOKEN_LAYOUT.size, UINT16, LITTLE, APPEND_END, s.vocabulary, SPLIT_CODE[s.split], len(t), len(s.lengths), len(body), s.end_id, int(t.min()), int(t.max()))
    binary = head + body
    entries, at = [], 0
    for n, d in zip(s.lengths, s.digests):
        entries.append(ENTRY_LAYOUT.pack(at, n, d))
        at += n
    raw = b"".join(entries)
    head = INDEX_LAYOUT.pack(INDEX_MAGIC, VERSION, INDEX_LAYOUT.size, ENTRY_LAYOUT.size, OFFSET_FROM_SHARD, LENGTH_WITH_END, len(t), len(s.lengths), s.token_start, s.document_start, hashlib.sha256(binary).digest(), len(raw), s.end_id)
    return binary, head + raw


def decode_index(raw: bytes) -> tuple[dict, list[tuple[int, int, bytes]]]:
    """Header values and entries; wrong magic, size, gaps, overlaps and bytes after the end are errors."""
    if len(raw) < INDEX_LAYOUT.size or raw[:8] != INDEX_MAGIC:
        raise ValueError("no index file")
    names = ["magic", "version", "header_bytes", "record_bytes", "offsets", "lengths", "tokens", "documents", "token_start", "document_start", "binary_sha256", "entry_bytes", "end_id"]
    head = dict(zip(names, INDEX_LAYOUT.unpack(raw[: INDEX_LAYOUT.size])))
    if (head["version"], head["header_bytes"], head["record_bytes"]) != (VERSION, INDEX_LAYOUT.size, ENTRY_LAYOUT.size) or any(raw[INDEX_LAYOUT.size - 36 : INDEX_LAYOUT.size]):
        raise ValueError("the index header is wrong")
    body = raw[INDEX_LAYOUT.size :]
    if len(body) != head["entry_bytes"] or head["entry_bytes"] != head["documents"] * ENTRY_LAYOUT.size:
        raise ValueError("the index has another size than its header says")
    entries = list(ENTRY_LAYOUT.iter_unpack(body))
    at = 0
    for start, n, _ in entries:
        if start != at or n < 1:
            raise ValueError("gap" if start > at else "overlap" if start < at else "zero length")
        at += n
    if at != head["tokens"]:
        raise ValueError("entries don't cover the tokens")
    return head, entries


def decode_tokens(raw: bytes) -> tuple[dict, np.ndarray]:
    """Header values and ids; sizes, reserved bytes, flags and observed extremes are checked."""
    if len(raw) < TOKEN_LAYOUT.size or raw[:8] != TOKEN_MAGIC:
        raise ValueError("no token file")
    names = ["magic", "version", "header_bytes", "dtype", "endian", "flags", "vocabulary", "split", "tokens", "documents", "payload", "end_id", "least", "greatest"]
    head = dict(zip(names, TOKEN_LAYOUT.unpack(raw[: TOKEN_LAYOUT.size])))
    if any(raw[21:24]) or any(raw[60:64]) or (head["version"], head["header_bytes"], head["dtype"], head["endian"], head["flags"]) != (VERSION, TOKEN_LAYOUT.size, UINT16, LITTLE, APPEND_END) or head["split"] not in SPLIT_CODE.values():
        raise ValueError("the token header is wrong")
    ids = np.frombuffer(raw, "<u2", offset=TOKEN_LAYOUT.size)
    if len(raw) - TOKEN_LAYOUT.size != head["payload"] or len(ids) != head["tokens"]:
        raise ValueError("the payload has another size than its header says")
    if len(ids) == 0 or (int(ids.min()), int(ids.max())) != (head["least"], head["greatest"]) or ids[-1] != head["end_id"]:
        raise ValueError("the payload doesn't fit its header")
    return head, ids


def write_shards(docs: DataFrame, folder: str) -> DataFrame:
    """Writes SPLIT-NNNNN.bin and .idx of each shard into a shared folder and returns a row about each.

    docs: split, shard_index, doc_ord, tokens, text_sha256 (hex), and the shard's token_start and document_start.  A shard is bounded by the
    packing's target, so one task holds one.  Files are written beside and renamed, so a repeated task leaves whole files.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        split, index = key[0].as_py(), key[1].as_py()
        t = table.sort_by("doc_ord")
        lists = t.column("tokens").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy()).tolist()
        shard = Shard(split, lists.flatten().to_numpy(), lengths, [bytes.fromhex(x) for x in t.column("text_sha256").to_pylist()], t.column("token_start")[0].as_py(), t.column("document_start")[0].as_py())
        out = encode_shard(shard)
        for suffix, data in zip((".bin", ".idx"), out):
            write_whole(folder, f"{split}-{index:05d}{suffix}", data)
        return pa.table({"split": [split], "shard_index": pa.array([index], pa.int32()), "documents": [len(lengths)], "tokens": [len(shard.tokens)], "bytes": [len(out[0])], "sha256": [hashlib.sha256(out[0]).hexdigest()]})

    ship(docs.sparkSession)
    return docs.groupBy("split", "shard_index").applyInArrow(run, "split string, shard_index int, documents bigint, tokens bigint, bytes bigint, sha256 string")


def read_index(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, doc_ord, start_token, length_tokens, text_sha256) of index files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                _, entries = decode_index(raw)
                cols = list(zip(*entries))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(entries)), pa.array(range(len(entries)), pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["path", "doc_ord", "start_token", "length_tokens", "text_sha256"])

    ship(spark)
    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInArrow(run, "path string, doc_ord bigint, start_token bigint, length_tokens bigint, text_sha256 binary")


def read_slices(slices: DataFrame, folder: str) -> DataFrame:
    """slices (split, shard_index, start, n) with their ids: a task seeks to each slice and reads its bytes alone, however long the payload is.

    A slice that isn't inside its payload is an error.
    """

    head = TOKEN_LAYOUT.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for b in batches:
            out = []
            for split, shard, start, n in zip(*(c.to_pylist() for c in b.columns)):
                with fs.open_input_file(f"{root}/{split}-{shard:05d}.bin") as f:
                    if start < 0 or n < 0 or head + 2 * (start + n) > f.size():
                        raise ValueError("the slice isn't inside its shard")
                    out.append(np.frombuffer(f.read_at(2 * n, head + 2 * start), "<u2").astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], names=["split", "shard_index", "start", "n", "ids"])

    ship(slices.sparkSession)
    d = slices.select("split", F.col("shard_index").cast("int"), F.col("start").cast("bigint"), F.col("n").cast("int"))
    return d.mapInArrow(run, "split string, shard_index int, start bigint, n int, ids array<int>")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(split, shard_index, doc_ord, start_token, length_tokens, token_start, text_sha256, tokens) of all shards: each index joined to its payload by name, which is
    checked against the index's digest; every document must end with the end id.  token_start is the shard's place in its split."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        files = {p[-4:]: raw for p, raw in zip(table.column("path").to_pylist(), table.column("content").to_pylist())}
        head, entries = decode_index(files[".idx"])
        if hashlib.sha256(files[".bin"]).digest() != head["binary_sha256"]:
            raise ValueError("the index belongs to another token file")
        stated, ids = decode_tokens(files[".bin"])
        if (stated["tokens"], stated["documents"]) != (head["tokens"], head["documents"]) or any(ids[s + n - 1] != stated["end_id"] for s, n, _ in entries):
            raise ValueError("the index doesn't fit the payload")
        split, _, index = key[0].as_py().rpartition("-")
        return pa.table({"split": [split] * len(entries), "shard_index": pa.array([int(index)] * len(entries), pa.int32()), "doc_ord": list(range(len(entries))), "start_token": [s for s, _, _ in entries], "length_tokens": [n for _, n, _ in entries], "token_start": [head["token_start"]] * len(entries), "text_sha256": [h.hex() for _, _, h in entries], "tokens": pa.array([ids[s : s + n].astype(np.int32) for s, n, _ in entries], pa.list_(pa.int32()))})

    ship(spark)
    files = spark.read.format("binaryFile").load(f"{folder}/*").where("path like '%.idx' or path like '%.bin'").select("path", "content").withColumn("name", F.regexp_extract("path", "([^/]+)\\.(?:bin|idx)$", 1))
    return files.groupBy("name").applyInArrow(run, "split string, shard_index int, doc_ord bigint, start_token bigint, length_tokens bigint, token_start bigint, text_sha256 string, tokens array<int>")
