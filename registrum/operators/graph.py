"""Connected components over string or number nodes, by alternating large and small stars; a staged table per round."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registrum.session import discard, staged


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of the component) of every node of `edges` (a, b), roots included."""
    ends = F.struct(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).alias("e")
    alone = edges.where("a = b").select(F.col("a").alias("node"))
    now = staged(edges.where("a <> b").select(ends).select("e.*").distinct(), "edges")
    mark, old = None, now
    while True:
        # Large star: of a node with smaller neighbours, the larger ones are tied to the smallest. Edges point downwards, so that is a look-up of their
        # lower end; of a centre that is smallest itself there is nothing to look up.
        low = now.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("low"))
        large = now.join(low, "b", "left").select("a", F.coalesce("low", "b").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        now = staged(large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "edges")
        discard(old)
        old = now
        before, mark = mark, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if mark == before:
            break
    tied = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = tied.select(F.col("root").alias("node")).distinct()
    single = alone.distinct().join(tied.unionByName(roots.select("node", F.col("node").alias("root"))), "node", "left_anti")
    return tied.unionByName(roots.unionByName(single).select("node", F.col("node").alias("root")))


def key_edges(keys: DataFrame, least: int = 2, most: int = 8) -> DataFrame:
    """Edges a, b from rows (uid, key): each member of a key with `least` to `most` members to its smallest; others are left out."""
    sized = keys.groupBy("key").agg(F.min("uid").alias("b"), F.count_distinct("uid").alias("members")).where(F.col("members").between(least, most))
    return keys.join(sized, "key").select(F.col("uid").alias("a"), "b").distinct()


def geo_pairs(points: DataFrame, metres: float = 50.0, dense: int = 15, bounds: tuple[float, float, float, float] = (45.0, 49.5, -125.0, -116.0), latitude: float = 47.5) -> DataFrame:
    """Pairs a < b of (uid, lat, lon) within `metres`: cells of that size, at `latitude`, meet their neighbours; a pair stays if the nine cells around
    either end hold at most `dense` points, so no crowded cell is joined with itself. Places outside `bounds` (south, north, west, east), zeros and nulls are none."""
    from registrum.functions.text import haversine

    south, north, west, east = bounds
    down, across = metres / 111_320.0, metres / (111_320.0 * math.cos(math.radians(latitude)))
    rows = points.where(F.col("lat").between(south, north) & F.col("lon").between(west, east) & (F.col("lat") != 0) & (F.col("lon") != 0))
    rows = rows.withColumn("x", (F.col("lat") / down).cast("long")).withColumn("y", (F.col("lon") / across).cast("long"))
    near = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(x + i as x, y + j as y))))"))
    counts = rows.groupBy("x", "y").agg(F.count("*").alias("n"))
    around = counts.select("n", near.alias("c")).groupBy("c").agg(F.sum("n").alias("around")).select("c.x", "c.y", "around")
    rows = rows.join(around, ["x", "y"])
    sparse = rows.where(F.col("around") <= dense).select(F.col("uid").alias("s"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), near.alias("c")).select("s", "lat1", "lon1", "c.x", "c.y")
    met = sparse.join(rows.select("uid", "lat", "lon", "x", "y"), ["x", "y"]).where("s <> uid")
    met = met.withColumn("metres", haversine(F.col("lat1"), F.col("lon1"), F.col("lat"), F.col("lon"))).where(F.col("metres") <= metres)
    return met.groupBy(F.least("s", "uid").alias("a"), F.greatest("s", "uid").alias("b")).agg(F.min("metres").alias("metres"))
