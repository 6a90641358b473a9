"""Grouped summaries of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scans


def located_edges(edges: DataFrame, nodes: DataFrame, how: str = "inner", targets: DataFrame | None = None) -> DataFrame:
    """Edges with the package of both ends; how='left' keeps edges of unknown targets. targets: the nodes that edges lead
    to, where these are others than those they leave from."""
    ends = lambda df, side: df.select(F.col("id").alias(side), F.col("package").alias(f"{side}_package"))
    return edges.join(ends(nodes, "source"), "source").join(ends(nodes if targets is None else targets, "target"), "target", how)


def component_relations(edges: DataFrame, nodes: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Relations between different packages by kind."""
    met = located_edges(edges, nodes, targets=targets).where("source_package <> target_package")
    return met.groupBy("source_package", "target_package", "kind").agg(F.count(F.lit(1)).alias("relations"))


def component_summary(nodes: DataFrame) -> DataFrame:
    """Packages with node counts, distinct folders and conditional counts."""
    return nodes.groupBy("package").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "order").alias("orders"),
        F.count_if(F.col("kind") == "customer").alias("customers"), F.count_distinct("kind").alias("kinds"), F.min("path").alias("first_path"),
    )


def dependents(relations: DataFrame) -> DataFrame:
    """Distinct packages that reach each package directly, from the relations between packages."""
    pairs = relations.select("source_package", F.col("target_package").alias("package")).distinct()
    return pairs.groupBy("package").agg(F.count(F.lit(1)).alias("dependents"))


def top(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows with their place. Only the n rows that a top-k leaves are numbered."""
    return rows.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """At most n rows of each key in order, with their place and the key's total. A key of any size is cut before the
    window: ranks come from a sort of the key's rows, and totals from a combined count."""
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)
    return ranked.join(total, keys).withColumn("truncated", F.col("total") > n)


def distinct_in_order(rows: DataFrame, keys: list[str], value: list[str], order: list[str], n: int) -> DataFrame:
    """First n distinct values of each key, by where they first stand."""
    first = rows.groupBy(*keys, *value).agg(F.min(F.struct(*order)).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("at", *value))).where(F.col("place") <= n).drop("at")


def within_budget(rows: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows of each key in order until their sizes fill a budget, with used (the running sum) and taken (the last clamped)."""
    summed = scans.running_sum(rows, [key], [order], size, "used")
    out = summed.where(F.col("used") - F.col(size) < budget)
    return out.withColumn("taken", F.least(F.col(size), F.lit(budget) - (F.col("used") - F.col(size))))
