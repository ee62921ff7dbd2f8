"""Table, hashing and offset helpers of the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, ship, spread, written



def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows, else df as it is (then a shuffle join is used).

    Rows are counted in Spark, up to the bound; those of these tables are some dozen bytes each.
    """
    return F.broadcast(df) if df.select(F.lit(1)).limit(rows + 1).count() <= rows else df


__all__ = ["MIX", "MIX2", "MIX3", "discard", "mix", "read", "ship", "small", "spread", "starts", "written"]

MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
MIX3 = np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (multiply, shift and multiply again)."""
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX2
    return x ^ (x >> np.uint64(32))


def starts(lengths: np.ndarray) -> np.ndarray:
    """Offsets 0, l0, l0 + l1, ... with the total at the end."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
