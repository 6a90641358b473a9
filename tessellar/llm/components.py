"""Connected components of a link table, by alternating large and small stars; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _settled(edges: DataFrame) -> bool:
    """Does every u hang under one v that hangs under nothing? One aggregate over the ends."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or below = 1 and above = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links: a, b (longs, a <> b). v, component (least v of its component) for every linked v.

    Large star: hang the larger neighbours of u under the least of its neighbourhood. Small star: hang u and its smaller
    neighbours under the least one. Both only need a minimum by node (combined on the map side) and a join that adaptive
    execution can split. It ends when the links are stars; rounds grow as the logarithm of the longest chain.
    """
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        met = large.join(_least(large), "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
        edges = keep(small.where("u <> v").distinct(), "links")
    return edges.select(F.col("u").alias("v"), F.col("v").alias("component")).unionByName(edges.select("v", F.col("v").alias("component")).distinct())
