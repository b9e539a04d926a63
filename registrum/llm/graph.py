"""Connected components of links that stay distributed: alternating large and small stars, a staged table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def components(links: DataFrame) -> DataFrame:
    """The rows of component_table(), whose table stays."""
    return component_table(links)[0]


def component_table(links: DataFrame) -> tuple[DataFrame, str]:
    """A table and its path: node and root (the smallest node of its component) of every node in `links` (a, b: numbers) but the roots themselves.

    A large star ties a node's larger neighbours to the smallest one, a small star its smaller ones; each keeps components whole, and a few
    rounds (in the logarithm of the longest path) leave one star per component. Self links and nulls are ignored.
    """
    spark = links.sparkSession
    ends = F.struct(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).alias("e")
    edges, path = staged(links.where("a <> b").select(ends).select("e.*").distinct(), "links")
    mark = _mark(edges)
    while True:
        # Edges point to the smaller node, so the large star is a look-up of their lower end: its smallest neighbour below it, if it has any.
        low = _lowest(edges).withColumnRenamed("a", "b")
        large = edges.join(low, "b", "left").select("a", F.coalesce("low", "b").alias("b")).distinct()
        low = _lowest(large)
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).distinct()
        new, new_path = staged(small, "links")
        discard(spark, path)
        edges, path, before, mark = new, new_path, mark, _mark(new)
        if mark == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")), path


def _lowest(edges: DataFrame) -> DataFrame:
    """a and low, its smallest neighbour. The key is made anew (a number xor 0), so that the plan doesn't join in the stage of this aggregate: with a shuffle
    of its own on either side, adaptive execution may split a centre's edges over tasks."""
    return edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").bitwiseXOR(F.lit(0).cast("long")).alias("a"), "low")


def _mark(edges: DataFrame) -> tuple:
    """Rows and an order-free digest of them."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
