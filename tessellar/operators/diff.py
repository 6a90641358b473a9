"""Comparison of two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows that a task of a comparison groups, about; the groups of so many take some 100 MB.
TASK_ROWS = 500_000


def tagged(before: DataFrame, after: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """columns of both sides with sign (1 before, -1 after), dealt by key to tasks of about TASK_ROWS rows, counted first. All
    grouping by key and more then goes on inside these tasks; copies are counted as they come, so a hot key takes time but
    no memory."""
    both = before.select(*columns, F.lit(1).alias("sign")).unionByName(after.select(*columns, F.lit(-1).alias("sign")))
    least = both.sparkSession.sparkContext.defaultParallelism
    return both.repartition(max(least, -(-both.count() // TASK_ROWS)), *key)


def multiset_diff(before: DataFrame, after: DataFrame, key: str, value: list[str]) -> DataFrame:
    """key, state, rows. Equal values cancel one for one; a key with exactly one row left on both sides is modified,
    whatever else is left is removed and added. Copies are counted, not numbered, so a hot key is one row a value."""
    left = tagged(before, after, [key], [key, *value]).groupBy(key, *value).agg(F.sum("sign").alias("d"))
    sums = left.groupBy(key).agg(F.sum(F.greatest("d", F.lit(0))).alias("removed"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("added"))
    one = (F.col("removed") == 1) & (F.col("added") == 1)
    states = F.when(one, F.array(F.struct(F.lit("modified").alias("state"), F.lit(1).cast("long").alias("rows")))).otherwise(
        F.array(F.struct(F.lit("removed").alias("state"), F.col("removed").alias("rows")), F.struct(F.lit("added").alias("state"), F.col("added").alias("rows")))
    )
    return sums.select(key, F.explode(states).alias("s")).select(key, "s.state", "s.rows").where("rows > 0")


def by_key(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, state: added, removed or modified as the values of a key differ as multisets. Copies are counted by value, so no
    list of a key's values is gathered."""
    sides = [F.sum("sign").alias("d"), F.bool_or(F.col("sign") > 0).alias("was"), F.bool_or(F.col("sign") < 0).alias("now")]
    met = tagged(before, after, [key], [key, value]).groupBy(key, value).agg(*sides)
    sums = met.groupBy(key).agg(F.bool_or(F.col("d") != 0).alias("differs"), F.bool_or("was").alias("was"), F.bool_or("now").alias("now"))
    state = F.when(~F.col("was"), "added").when(~F.col("now"), "removed").when(F.col("differs"), "modified")
    return sums.select(key, state.alias("state")).where("state is not null")


def one_sided(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows of one side only, with state added or removed."""
    met = tagged(before, after, columns, columns).groupBy(*columns).agg(F.max("sign").alias("most"), F.min("sign").alias("least"))
    return met.where("most = least").select(*columns, F.when(F.col("most") > 0, "removed").otherwise("added").alias("state"))


def priority(state: Column, signature_changed: Column, public: Column) -> Column:
    """3 where an interface is concerned, 2 where callers may break, 1 otherwise."""
    return F.when((state == "modified") & signature_changed & public, 3).when((state == "removed") & public, 3).when(state == "removed", 2).otherwise(1)


def stale(stored: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose stored value is missing or different now, or that are new."""
    met = stored.select(key, F.col(value).alias("was")).join(current.select(key, F.col(value).alias("now")), key, "full")
    return met.where(~F.col("was").eqNullSafe(F.col("now")))
