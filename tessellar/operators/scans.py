"""Running values by key that split a key of any size.

Rows are dealt to ranges of (key, order), so that a hot key lies in many ranges. Each range works out its own running value;
what a range hands on is one row for each of its keys, and only keys that span ranges need it: two rows a range at most.
Columns of the order have to tell rows apart where the result depends on it; rows equal in key and order stay in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import keep

RANGE = "__range"


def dealt(rows: DataFrame, key: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """rows with the number of their range of (key, order), written once so that every reader sees the same ranges."""
    columns = [*key, *order]
    ranged = rows.repartitionByRange(ranges, *columns) if ranges else rows.repartitionByRange(*columns)
    return keep(ranged.withColumn(RANGE, F.spark_partition_id()), "ranges")


def _carried(pieces: DataFrame, key: list[str], carry: Column) -> DataFrame:
    """key, range, carry of the pieces that are not the first of their key."""
    named = pieces.withColumn("__carry", carry).where("__carry is not null")
    return named.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.col(RANGE).alias("__r"), "__carry")


def _met(local: DataFrame, carried: DataFrame, key: list[str]) -> DataFrame:
    same = F.col(RANGE) == F.col("__r")
    for i, k in enumerate(key):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return local.join(F.broadcast(carried), same, "left")  # two rows a range at most


def _without(df: DataFrame, key: list[str]) -> DataFrame:
    return df.drop(RANGE, "__r", "__carry", *[f"__k{i}" for i in range(len(key))])


def running_last(rows: DataFrame, key: list[str], order: list[str], value: str, name: str, before: bool = False, ranges: int | None = None) -> DataFrame:
    """rows with ``name``: the last value that is not null up to their own row, or up to the row before it; null for none."""
    laid = dealt(rows, key, order, ranges)
    own = Window.partitionBy(*key, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    local = laid.withColumn(name, F.last(value, ignorenulls=True).over(own))
    last = F.max_by(value, F.struct(*order)).alias("__last")
    pieces = laid.where(F.col(value).isNotNull()).groupBy(*key, RANGE).agg(last)
    every = laid.groupBy(*key, RANGE).agg(F.lit(1).alias("__one"))  # a range without a value hands on what it was handed
    spans = every.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*key))).where("__n > 1").drop("__n", "__one")
    same = F.col("a." + RANGE) == F.col("b." + RANGE)
    for k in key:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    told = spans.alias("a").join(pieces.alias("b"), same, "left").select(*[F.col(f"a.{c}") for c in spans.columns], "b.__last")
    up = Window.partitionBy(*key).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = _carried(told, key, F.last("__last", ignorenulls=True).over(up))
    return _without(_met(local, carried, key).withColumn(name, F.coalesce(name, "__carry")), key)


def running_sum(rows: DataFrame, key: list[str], order: list[str], value: str, name: str, ranges: int | None = None) -> DataFrame:
    """rows with ``name``: the sum of value up to and with their own row, null where no value came yet."""
    laid = dealt(rows, key, order, ranges)
    own = Window.partitionBy(*key, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = laid.withColumn(name, F.sum(value).over(own))
    pieces = laid.groupBy(*key, RANGE).agg(F.sum(value).alias("__sum"))
    up = Window.partitionBy(*key).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = _carried(pieces, key, F.sum("__sum").over(up))
    total = F.coalesce(F.col(name) + F.col("__carry"), F.col(name), F.col("__carry"))
    return _without(_met(local, carried, key).withColumn(name, total), key)


def numbered(rows: DataFrame, order: list[str], name: str = "row_number", ranges: int | None = None) -> DataFrame:
    """rows with their number, from 0, in one total order: a range sort, and an offset for each range."""
    laid = dealt(rows, [], order, ranges)
    counts = laid.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(F.col(RANGE).alias("__r"), (F.sum("n").over(Window.orderBy(RANGE)) - F.col("n")).alias("__start"))  # a row for each range
    own = Window.partitionBy(RANGE).orderBy(*order)
    met = laid.withColumn(name, F.row_number().over(own)).join(F.broadcast(starts), F.col(RANGE) == F.col("__r"))
    return met.withColumn(name, F.col(name) + F.col("__start") - 1).drop(RANGE, "__r", "__start")
