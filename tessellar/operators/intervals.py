"""Interval and as-of joins within a key.

Spans lie in bins of about their own size: one of level L (2**L is not below its length; levels go up by STEP) touches two bins of
2**L at most, however long it is. What is looked up (a point, or a span no longer than the other) touches two bins a level at most, on
the levels that exist, 17 at most. So no span is cut into pieces, and rows only meet near each other. A bin is under 2**STEP times as
long as its spans; in return points are copied to fewer levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scans


STEP = 4
MOST_LEVEL = 63


def level_of(start: Column, end: Column) -> Column:
    """The least of the levels 0, STEP, 2 * STEP, ... whose bins are not shorter than [start, end)."""
    least = F.when(end - start > 1, F.length(F.bin(end - start - 1))).otherwise(0)
    return F.least(F.ceil(least / STEP) * STEP, F.lit(MOST_LEVEL)).cast("int")


def bins(start: Column, end: Column, level: Column) -> Column:
    """Numbers of the one or two bins of a level that [start, end) touches; none for an empty span."""
    first, last = (F.call_function("shiftright", x, level) for x in (start.cast("long"), (end - 1).cast("long")))
    return F.when(start < end, F.when(first == last, F.array(first)).otherwise(F.array(first, last)))


def levels(spans: DataFrame, start: str = "start", end: str = "end") -> list[int]:
    """The levels that spans lie on; a span is shorter than 2**63, so there are 17 at most."""
    return sorted(r[0] for r in spans.where(F.col(start) < F.col(end)).select(level_of(F.col(start), F.col(end)).cast("int")).distinct().collect())


def placed(spans: DataFrame, start: str, end: str) -> DataFrame:
    """spans with the level and each bin of their own size."""
    own = spans.where(F.col(start) < F.col(end)).withColumn("__level", level_of(F.col(start), F.col(end)).cast("int"))
    return own.withColumn("__bin", F.explode(bins(F.col(start), F.col(end), F.col("__level"))))


def looked_up(rows: DataFrame, start: Column, end: Column, on: list[int], least: Column) -> DataFrame:
    """rows with the bins that they touch on every level of ``on`` that is not below ``least``."""
    wanted = F.filter(F.array(*[F.lit(k) for k in on]).cast("array<int>"), lambda k: k >= least)
    at = rows.withColumn("__level", F.explode(wanted))
    return at.withColumn("__bin", F.explode(bins(start, end, F.col("__level"))))


def containing(points: DataFrame, spans: DataFrame, key: list[str], at: str = "at", start: str = "start", end: str = "end", on: list[int] | None = None) -> DataFrame:
    """Every point with every span of its key that holds it: start <= at < end. Columns of both; only the key is shared."""
    on = levels(spans, start, end) if on is None else on
    near = looked_up(points, F.col(at), F.col(at) + 1, on, F.lit(0))
    met = near.join(placed(spans, start, end), [*key, "__level", "__bin"])
    return met.where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("__level", "__bin")


def innermost(points: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """points (key, at) with the span (start, end, name) of the same key that holds them and starts last."""
    best = containing(points, spans, [key]).groupBy(*points.columns).agg(F.max(F.struct("start", "name")).alias("s"))
    return best.select(*points.columns, F.col("s.start").alias("start"), F.col("s.name").alias("name"))


def overlapping(spans: DataFrame, others: DataFrame, key: str, n: int) -> DataFrame:
    """For each span (id, start, end) at most n others (other, from, to) of its key that overlap it, narrowest first. The
    shorter of two is looked up on the level of the longer; they count in the bin where the later of both begins, once."""
    left, right = levels(spans), levels(others, "from", "to")
    short = looked_up(spans, F.col("start"), F.col("end"), right, level_of(F.col("start"), F.col("end")))
    one = short.join(placed(others, "from", "to"), [key, "__level", "__bin"])
    long = looked_up(others, F.col("from"), F.col("to"), left, level_of(F.col("from"), F.col("to")) + 1)
    two = placed(spans, "start", "end").join(long, [key, "__level", "__bin"])
    met = one.unionByName(two).where((F.col("from") < F.col("end")) & (F.col("to") > F.col("start")))
    met = met.where(F.col("__bin") == F.call_function("shiftright", F.greatest("start", "from").cast("long"), F.col("__level"))).drop("__level", "__bin")
    order = Window.partitionBy("id").orderBy(F.col("to") - F.col("from"), "other")
    return met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def preceding(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left rows with the value of the last right row of their key at or before them (null where there is none). A union
    in time order and a running last value, which splits a key of any size; no pairs."""
    tagged = left.withColumn("__turn", F.lit(1)).withColumn("__value", F.lit(None).cast(right.schema[value].dataType))
    other = right.select(key, at, F.col(value).alias("__value")).withColumn("__turn", F.lit(0))
    both = tagged.unionByName(other, allowMissingColumns=True)
    found = scans.running_last(both, [key], [at, "__turn", "__value"], "__value", value)
    return found.where("__turn = 1").drop("__turn", "__value")
