"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, written


def _least(edges: DataFrame) -> DataFrame:
    """Each node with the least of itself and its neighbours (partial minima before the shuffle)."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _least(down)
    to = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to.union(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a written table, with their number and checksum, observed while they are written."""
    seen = Observation()
    return written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges"), tuple(sorted(seen.get.items()))


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge to another one; component is the least node reached.

    Rounds of large-star and small-star run until the set of edges stays the same; each round's edges are written to
    the shared folder, so lineage stays short and no edge ever reaches the driver.  Null ends and loops are ignored;
    repeated edges count once; no edges give no rows.
    """
    e = edges.select(F.col(u).cast("bigint").alias("u"), F.col(v).cast("bigint").alias("v")).na.drop().where("u <> v")
    e, mark = _marked(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        before = e
        e, now = _marked(_small_star(_large_star(e)))
        discard(before)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components didn't settle")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
