"""Path rules: forbidden relations, owners by prefix, members by glob."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.predicates import glob_pattern
from ..storage import keep
from . import scans

#: Paths and prefixes of a task that looks for owners, about.
TASK_ROWS = 500_000

# How the target of a relation was established where it counts as known.
KNOWN_RESOLUTIONS = ["resolved", "semantic", "static", "interface", "virtual"]


def known_target(resolution: str) -> Column:
    return F.col(resolution).isin(KNOWN_RESOLUTIONS)


def violations(edges: DataFrame, nodes: DataFrame, rules: list[tuple[int, str, str]]) -> DataFrame:
    """Relations whose ends match both globs of a rule (position, from_glob, to_glob); a relation comes once for each rule.
    Every pattern is a literal and is matched once for each node, on the path: nodes carry the positions of the rules whose
    globs they match, and nodes that match none take no part in the joins."""
    hits = lambda k: F.filter(F.array(*[F.when(F.regexp(F.col("path"), glob_pattern(F.lit(r[k]))), r[0]) for r in rules]), lambda p: p.isNotNull())
    side = lambda name, k: nodes.select(F.col("id").alias(name), F.col("path").alias(f"{name}_path"), hits(k).alias(f"__{name}")).where(F.size(f"__{name}") > 0)
    met = edges.join(side("source", 1), "source").join(side("target", 2), "target")
    return met.withColumn("position", F.explode(F.array_intersect("__source", "__target"))).drop("__source", "__target")


def first_findings(found: DataFrame, n: int) -> DataFrame:
    """The first n findings by the paths of their ends, with place, total and whether more follow."""
    order = ["source_path", "target_path", "id", "position"]
    total = found.agg(F.count(F.lit(1)).alias("total"))
    placed = found.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return placed.join(F.broadcast(total)).withColumn("truncated", F.col("total") > n)


def owners(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """path, prefix: the longest prefix that is the path or a folder above it, once for each path that has one. Paths and
    prefixes are dealt to counted ranges in the order in which a walk of the tree meets them, so that a folder above everything
    is no hot key. A range keeps the prefixes above its row on a stack, and begins with those above its first row."""
    side = lambda df, name, asked: df.select(F.col(name).alias("path"), F.lit(asked).alias("asked")).where("path is not null")
    both = side(paths, "path", True).unionByName(side(prefixes, "prefix", False))
    rows = keep(both.groupBy("path").agg(F.bool_or("asked").alias("asked"), F.bool_or(~F.col("asked")).alias("owns")), "owners")
    ranges = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    walk = F.col("path")  # the sign below all others parts folders, so that what is under a path follows it at once
    for sign, instead in (("\x01", "\x01\x02"), ("\x00", "\x01\x01"), ("/", "\x00")):
        walk = F.replace(walk, F.lit(sign), F.lit(instead))
    laid = scans.dealt(rows.withColumn("walk", walk), [], ["walk"], ranges)
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    first = laid.groupBy(scans.RANGE).agg(F.min_by("path", "walk").alias("path")).select(scans.RANGE, F.explode(F.concat(F.array(F.lit("")), above)).alias("path"))
    begun = laid.where("owns").drop(scans.RANGE).join(F.broadcast(first), "path").withColumn("asked", F.lit(False))  # a path's own few folders for each range
    each = laid.unionByName(begun).repartitionById(ranges, scans.RANGE).sortWithinPartitions("walk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []  # prefixes above the row, and what paths below them begin with
        for batch in batches:
            found: list[tuple[str, str]] = []
            for path, asked, owns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                while held and held[-1][0] != path and not path.startswith(held[-1][1]):
                    held.pop()
                if owns and not (held and held[-1][0] == path):
                    held.append((path, path and path + "/"))
                if asked and held:
                    found.append((path, held[-1][0]))
            yield pa.record_batch({"path": pa.array([f[0] for f in found], pa.string()), "prefix": pa.array([f[1] for f in found], pa.string())})

    return each.select("path", "asked", "owns").mapInArrow(run, "path string, prefix string")


def members(paths: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Paths that some include glob matches and no exclude glob."""
    any_of = lambda globs: F.exists(F.array(*map(F.lit, globs)), lambda g: F.regexp(F.col("path"), glob_pattern(g)))
    return paths.where(any_of(include) & ~any_of(exclude)) if exclude else paths.where(any_of(include))
