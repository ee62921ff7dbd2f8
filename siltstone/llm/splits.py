"""Splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small
from .components import connected_components

#: Cells of the component hash, the units that are given to splits.
CELLS = 1 << 14


def entity_components(records: DataFrame, key: str, entities: list[str]) -> DataFrame:
    """(key, component): records that share a value of any entity column, directly or through others, get one component.

    Equal combinations of entity values are contracted first, so the graph has entities as nodes, not records, and a
    value that a third of all rows share is one node with few edges.  Values of different columns never meet.  A record whose entities are all null has a null component.
    """
    ids = [F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(c), F.col(c).cast("string"))).alias(f"_e{i}") for i, c in enumerate(entities)]
    tagged = records.select(F.col(key), *ids)
    names = [f"_e{i}" for i in range(len(entities))]
    anchor = F.coalesce(*names)
    combos = tagged.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).withColumn("u", anchor)
    edges = combos.select("u", F.explode(F.array(*names)).alias("v")).where("v is not null")
    comp = connected_components(edges)
    return (
        tagged.withColumn("node", anchor)
        .join(small(comp, 50_000), "node", "left")
        .select(F.col(key), F.coalesce("component", "node").alias("component"))
    )


def grouped_splits(components: DataFrame, key: str, targets: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """(key, component, split): every component in one split, record shares near the targets.

    The hash of a component is one of CELLS cells.  Cells are counted with map-side partial sums and given to splits,
    largest first, each to the split with most room left of its target; so a component that holds a third of all rows is
    a cell like any other, and its split gets less of the rest.  Records without a component stand alone and are
    hashed by their key.

    A growing corpus hands over its ``earlier`` assignment (key, split): a component with earlier records stays in the split
    that most of them are in (it can join components of two splits; then the smaller part moves), and only new components
    are given to splits.  Null targets, and earlier splits without a target, are ignored; an empty table gives no rows.
    """
    t = [(r[0], float(r[1])) for r in targets.select("split", "target_ratio").na.drop().orderBy(F.desc("target_ratio"), "split").limit(1000).collect() if r[1] > 0]
    if not t:
        raise ValueError("no target ratios")
    spark = components.sparkSession
    whole = sum(r for _, r in t)
    rec = components.select(key, "component").withColumn("_group", F.coalesce("component", F.xxhash64(F.lit("alone"), F.col(key))))
    rec = rec.withColumn("_cell", F.pmod(F.xxhash64(F.lit("split"), F.col("_group")), F.lit(CELLS)).cast("int"))
    if earlier is None:
        rec = rec.withColumn("_kept", F.lit(None).cast("string"))
    else:
        old = earlier.select(key, F.col("split").alias("_s")).where(F.col("_s").isin([s for s, _ in t])).dropDuplicates([key])
        votes = rec.join(old, key).groupBy("_group", "_s").agg(F.count(F.lit(1)).alias("n"))
        rec = rec.join(votes.groupBy("_group").agg(F.max_by("_s", F.struct("n", "_s")).alias("_kept")), "_group", "left")
    mass = [(r[0], r[1], r[2]) for r in rec.groupBy("_cell", "_kept").agg(F.count(F.lit(1)).alias("n")).collect()]  # at most CELLS * (splits + 1) rows
    total = sum(n for _, _, n in mass)
    room = {s: total * r / whole for s, r in t}
    for _, kept, n in mass:
        if kept is not None:
            room[kept] -= n
    given = []
    for n, cell in sorted(((n, c) for c, kept, n in mass if kept is None), key=lambda x: (-x[0], x[1])):
        s = max(room, key=lambda x: room[x])
        given.append((cell, s))
        room[s] -= n
    place = F.broadcast(spark.createDataFrame(given, "_cell int, _given string"))
    return rec.join(place, "_cell", "left").select(F.col(key), "component", F.coalesce("_kept", "_given").alias("split"))


def straddling(components: DataFrame, records: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys of records whose component occurs in more than one value of split; null splits are no split."""
    both = components.join(records.select(key, split), key)
    spread = both.where("component is not null").groupBy("component").agg(F.min(split).alias("lo"), F.max(split).alias("hi")).where("lo <> hi").select("component")
    return components.join(small(spread, 50_000), "component", "left_semi").select(key)


def split_shares(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Record counts, shares and targets of each split."""
    n = assigned.groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("component").alias("groups"))
    w = Window.partitionBy(F.lit(1))
    return n.join(F.broadcast(targets), "split", "full").select("split", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("groups", F.lit(0)).alias("groups"), (F.coalesce("records", F.lit(0)) / F.sum("records").over(w)).alias("share"), "target_ratio")
