"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorikeet.session import cut_lineage, release


def _signature(edges: DataFrame) -> tuple:
    """Count, sum and parity of the hashes of a table's distinct rows: equal for equal tables."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every end of a link; the smallest node names the component.

    Each round hooks every node's larger neighbours, then its smaller ones, to the
    smallest node in reach; the rounds end when nothing changes, after a number
    logarithmic in the largest component.  Only groupings and joins on a node are
    used, and lineage is cut after each round.
    """
    edges = links.select("a", "b").where("a <> b")
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _signature(edges)
    while True:
        # Every side of these joins grows with the data: they sort and merge, whatever
        # the planner makes of the size of a compressed table.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = cut_lineage(small.where("u <> v").distinct())
        after = _signature(new)
        release(edges)
        edges, same, before = new, after == before, after
        if same:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
