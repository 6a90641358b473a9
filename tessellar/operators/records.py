"""Append-only records and reading marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(records: DataFrame, key: str, revision: str) -> DataFrame:
    """The row of the highest revision of each key; a combined maximum, so that a long history never meets in one task."""
    rest = [c for c in records.columns if c not in (key, revision)]
    best = records.groupBy(key).agg(F.max_by(F.struct(revision, *rest), F.struct(revision, *rest)).alias("r"))
    return best.select(key, "r.*")


def next_revision(records: DataFrame, keys: DataFrame, key: str, revision: str) -> DataFrame:
    """keys with the revision that a new record of each gets: one after the highest, 1 for a new key."""
    top = records.groupBy(key).agg(F.max(revision).alias("top"))
    return keys.join(top, key, "left").select(key, (F.coalesce("top", F.lit(0)) + 1).alias("next_revision"))


def validity(evidence: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """evidence rows with valid: is the value stored with them still the current one?"""
    now = current.select(key, F.col(value).alias("__now"))
    return evidence.join(now, key, "left").withColumn("valid", F.col(value).eqNullSafe(F.col("__now"))).drop("__now")


def appeared(absent: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Keys that were noted as absent and are there now."""
    return current.select(key).join(absent.select(key).distinct(), key, "left_semi")


def put(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """stored with the rows of fresh inserted, or in the place of those of their key."""
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def chosen(stored: DataFrame, wanted: DataFrame, key: str, name: str, created: str) -> DataFrame:
    """The stored row (key, name, created) that each wanted (key, name) asks for by name; where the name is null the one created
    last, of equal ones the greatest name. by_id tells which. A name that is not stored has no row."""
    last = stored.groupBy(key).agg(F.max_by(name, F.struct(created, name)).alias("__last"))
    asked = wanted.join(last, key).select(key, F.coalesce(name, "__last").alias(name), F.col(name).isNotNull().alias("by_id"))
    return stored.join(asked, [key, name])
