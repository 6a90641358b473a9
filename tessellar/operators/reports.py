"""Reports: items of named sections, paged for each dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import keep

ITEM = ["dimension", "ordinal", "section", "item", "title", "summary"]


def section(rows: DataFrame, dimension: str, ordinal: int, name: str, item: str, title: str, summary: str, where: str = "true") -> DataFrame:
    """rows as items; item, title and summary are SQL over their columns, where tells which rows count."""
    parts = {"item": item, "title": f"coalesce({title}, '')", "summary": summary}
    fixed = [F.lit(dimension).alias("dimension"), F.lit(ordinal).alias("ordinal"), F.lit(name).alias("section")]
    return rows.where(where).select(*fixed, *[F.expr(e).cast("string").alias(k) for k, e in parts.items()])


def paged(items: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """dimension, section, item, title, summary, place, total, next_offset (null at the end): of every dimension the items after
    ``offset``, ``limit`` at most, by section, title and item. Items are worked out once; ranks beyond the page are dropped
    on the map side."""
    kept = keep(items, "report-items")
    total = kept.groupBy("dimension").agg(F.count(F.lit(1)).alias("total"))
    order = Window.partitionBy("dimension").orderBy("ordinal", "title", "item")
    page = kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= offset + limit).where(F.col("place") > offset)
    met = page.join(F.broadcast(total), "dimension")  # one row a dimension
    return met.select("dimension", "section", "item", "title", "summary", "place", "total", F.when(F.col("total") > offset + limit, offset + limit).alias("next_offset"))
