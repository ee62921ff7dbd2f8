"""The session around the plans: code for workers, tables in the shared folder, scans dealt to all cores."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_local_root: str | None = None
_written: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the session's workers, once a session."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="siltstone-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "siltstone_core.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    spark.sparkContext.addPyFile(target)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir``; in local mode, where that is unset (tests), a temporary one.

    On a cluster a folder of one machine would hold only what that machine wrote, so there the setting must be made.
    """
    global _local_root
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return f"file://{_local_root}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df once into the shared folder and reads it back.

    This cuts the lineage with a table that outlives any executor, so later jobs neither recompute Python stages nor
    depend on a lost executor's blocks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siltstone/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _written.append((spark, path))
    table._siltstone_path = path
    return table


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made and that no later result reads."""
    for t in tables:
        path = t._siltstone_path
        _written.remove((t.sparkSession, path))
        _remove(t.sparkSession, path)


def _drop_written() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session is gone already
            return


atexit.register(_drop_written)


#: A scan of more bytes a core than this has work enough for every core, whatever its partitions.
SPREAD_BYTES = 64 << 20


def spread(scan: DataFrame) -> DataFrame:
    """A small scan dealt to all cores if it has fewer partitions than there are cores, as a small unsplittable file has; else as it is.

    Only scans of at most SPREAD_BYTES a core are shuffled for it, so no large table ever is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores or int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES * cores:
        return scan
    return scan.repartition(cores)
