"""Files around the tables: source lists, digests, published documents."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import encode

#: Environment variable that names a local cache of the source files.
CACHE_VARIABLE = "SILTSTONE_SOURCE_CACHE"


def check_source_path(path: str) -> str:
    """A source path is relative, normal, without dot segments, and ends in .parquet."""
    parts = path.split("/")
    if not path or path.startswith("/") or "\\" in path or any(p in ("", ".", "..") for p in parts) or not path.endswith(".parquet"):
        raise ValueError(f"{path!r} is no relative, normal .parquet path")
    return path


def resolve_sources(paths: list[str], base: str, variable: str = CACHE_VARIABLE) -> list[str]:
    """Full places of the source files, under the cache that the environment names or else under base."""
    if len(set(paths)) != len(paths):
        raise ValueError("a source path is given twice")
    root = os.environ.get(variable) or base
    if os.environ.get(variable) and not os.path.isabs(root):
        raise ValueError("the source cache must be an absolute path")
    return [f"{root.rstrip('/')}/{check_source_path(p)}" for p in paths]


def pinned_sources(paths: list[str], base: str, revision: str) -> list[str]:
    """Places of the source files of one revision of a data set, base/revision/path; a revision is a full 40-digit hash, never a moving name."""
    if not re.fullmatch("[0-9a-f]{40}", revision):
        raise ValueError("the revision must be a full hash")
    return resolve_sources(paths, f"{base.rstrip('/')}/{revision}")


def read_sources(spark: SparkSession, places: list[str], columns: list[str]) -> DataFrame:
    """Explicit Parquet files as one table with only the wanted columns, and file order and row order as source_ord.

    Rows are numbered by file and by row in file, from the reader's own metadata, so no shuffle decides the order.
    """
    parts = None
    for n, place in enumerate(places):
        one = spark.read.parquet(place).select(*columns, (F.lit(n).cast("bigint") * (1 << 40) + F.col("_metadata.row_index")).alias("source_ord"))
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        raise ValueError("no source files")
    return parts


def discover_split_files(root: str | Path, splits: tuple[str, ...] = ("train", "validation", "test"), shards: int | None = None) -> dict[str, list[Path]]:
    """Files shard-NNNNN/SPLIT.jsonl in order; every split must be in every shard, and shards be as many as stated."""
    folders = sorted(p for p in Path(root).iterdir() if p.is_dir() and re.fullmatch(r"shard-\d{5}", p.name))
    if shards is not None and len(folders) != shards:
        raise ValueError(f"{len(folders)} shards found, {shards} expected")
    if [f.name for f in folders] != [f"shard-{i:05d}" for i in range(len(folders))]:
        raise ValueError("shard numbers are not contiguous")
    out = {s: [f / f"{s}.jsonl" for f in folders] for s in splits}
    for p in (p for files in out.values() for p in files):
        if not p.is_file():
            raise FileNotFoundError(p)
    return out


def file_digest(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def file_table(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, bytes, sha256) of files, hashed on the executors; for files that fit a task's memory."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_json(path: str | Path, value) -> bool:
    """Writes through a temporary file, a flush to disk and a rename; the same bytes are left alone (False)."""
    path, data = Path(path), encode(value)
    if path.exists() and path.read_bytes() == data:
        return False
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    except BaseException:
        os.unlink(temp)
        raise
    return True


def publish_new(path: str | Path, value) -> None:
    """Writes a document that must not exist yet; a second publisher fails instead of overwriting."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile(dir=path.parent, delete=False) as f:
        f.write(encode(value))
    try:
        os.link(f.name, path)
    finally:
        os.unlink(f.name)
