"""Grouped counts that are kept up to date from changes.

A change is rows with a sign: +1 for what came, -1 for what went. Counts of groups are folded with the counts of a
change, and groups that come to nothing go. For relations between packages a change of edges or of a node's package concerns
the edges it touches only; these are counted out under the old packages and in under the new ones. Whatever can be said of a group from
counted values (distinct paths, the least documentation) is read off the stored counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def signed(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows that differ as multisets, with sign: as many + or - as one side has more of them."""
    columns = after.columns
    both = after.withColumn("sign", F.lit(1)).unionByName(before.select(*columns).withColumn("sign", F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("sign").alias("sign")).where("sign <> 0")


def counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: the counts of a table from nothing."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def folded(stored: DataFrame, change: DataFrame, keys: list[str]) -> DataFrame:
    """stored (keys, n) after a change (keys, sign)."""
    delta = change.groupBy(*keys).agg(F.sum("sign").alias("n"))
    both = stored.select(*keys, "n").unionByName(delta.select(*keys, "n"))
    return both.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")


def relation_change(before_edges: DataFrame, after_edges: DataFrame, before_nodes: DataFrame, after_nodes: DataFrame) -> DataFrame:
    """source_package, target_package, kind, sign: what a snapshot diff does to the relations between packages. edges: id
    (where source, target and kind do not tell them apart), source, target, kind; nodes: id, package. An edge counts where
    both ends are known and in different packages."""
    moved = signed(before_nodes.select("id", "package"), after_nodes.select("id", "package")).select("id").distinct()
    edge = [c for c in ("id", "source", "target", "kind") if c in before_edges.columns]
    changed = signed(before_edges.select(*edge), after_edges.select(*edge))
    ends = lambda nodes, side: nodes.select(F.col("id").alias(side), F.col("package").alias(f"{side}_package"))

    def located(edges: DataFrame, nodes: DataFrame, sign) -> DataFrame:
        met = edges.join(ends(nodes, "source"), "source").join(ends(nodes, "target"), "target").where("source_package <> target_package")
        return met.select("source_package", "target_package", "kind", sign.cast("long").alias("sign"))

    # edges that stay, with an end that moved: out under the old packages, in under the new ones
    by_source = before_edges.select(*edge).join(moved.withColumnRenamed("id", "source"), "source", "left_semi")
    by_target = before_edges.select(*edge).join(moved.withColumnRenamed("id", "target"), "target", "left_semi").join(moved.withColumnRenamed("id", "source"), "source", "left_anti")
    touched = by_source.select(*edge).unionByName(by_target.select(*edge))
    out = located(touched, before_nodes, F.lit(-1)).unionByName(located(touched, after_nodes, F.lit(1)))
    return out.unionByName(located(changed, after_nodes, F.col("sign")))


def described(stored: DataFrame, group: str, value: str) -> DataFrame:
    """Of counted (group, value) rows: members in all, distinct values and the least one."""
    return stored.groupBy(group).agg(F.sum("n").alias("members"), F.count(F.lit(1)).alias(f"{value}s"), F.min(value).alias(f"first_{value}"))
