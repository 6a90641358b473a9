"""Capture of a working tree as a table of files, and its content identity."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.ident import frame
from ..functions.predicates import DENIED_COMPONENTS, admitted, glob_pattern
from ..operators import line_diff
from ..storage import keep

#: Files beyond this size are not taken.
MAX_BYTES = 32 << 20
#: Hidden folders that are searched all the same.
SEARCHED = [".cargo", ".config", ".github", ".gitlab", ".circleci"]
FILES_A_PARTITION = 500


class TreeReader(DataSourceReader):
    """The driver walks the folders once (names only); each partition reads its files. The tree has to be mounted where
    tasks run. Spark's own file sources pass over names that begin with an underscore, which source trees have."""

    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        listed = []
        for folder, inner, names in os.walk(self.root):
            inner[:] = sorted(d for d in inner if d not in DENIED_COMPONENTS and (d[0] != "." or d in SEARCHED) and not os.path.islink(os.path.join(folder, d)))
            paths = [os.path.join(folder, n) for n in sorted(names)]
            listed += [os.path.relpath(p, self.root) for p in paths if os.path.isfile(p) and not os.path.islink(p)]
        return [InputPartition(listed[i : i + FILES_A_PARTITION]) for i in range(0, len(listed), FILES_A_PARTITION)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int, bytes | None]]:
        for path in partition.value:
            with open(os.path.join(self.root, path), "rb") as f:
                size = os.fstat(f.fileno()).st_size
                yield path.replace(os.sep, "/"), size, f.read() if size <= MAX_BYTES else None


class TreeSource(DataSource):
    """format("worktree") with the option root: path, length, content."""

    @classmethod
    def name(cls) -> str:
        return "worktree"

    def schema(self) -> str:
        return "path string, length long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options["root"])


def capture(spark: SparkSession, root: str, ignore: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, diagnostics). files: path (relative), content, hash of every admitted file of valid UTF-8. diagnostics:
    code, path of what was left out for its size or its bytes. ignore: globs over relative paths."""
    spark.dataSource.register(TreeSource)
    taken = spark.read.format("worktree").option("root", root.removeprefix("file://")).load().where(admitted(F.col("path")))
    for g in ignore or []:
        taken = taken.where(~F.regexp(F.col("path"), glob_pattern(F.lit(g))))
    small = taken.where("content is not null")
    valid = F.expr("is_valid_utf8(cast(content as string))")
    files = small.where(valid).select("path", F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("hash"))
    wrong = taken.where("content is null").select(F.lit("file_too_large").alias("code"), "path")
    return files, wrong.unionByName(small.where(~valid).select(F.lit("invalid_utf8").alias("code"), "path"))


def content_id(files: DataFrame, revision: str) -> DataFrame:
    """One row: the identity of a revision and all (path, hash) in path order. Only paths and hashes are gathered."""
    pairs = F.sort_array(F.collect_list(F.struct("path", "hash")))
    whole = F.aggregate(pairs, frame(F.lit(revision)), lambda acc, x: F.concat(acc, frame(x["path"]), frame(x["hash"])))
    return files.agg(F.sha2(whole, 256).alias("content_id"))


def changed_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, state of what differs between two captures."""
    met = before.select("path", F.col("hash").alias("was")).join(after.select("path", F.col("hash").alias("now")), "path", "full")
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("modified")
    return met.where(~F.col("was").eqNullSafe(F.col("now"))).select("path", state.alias("state"))


def line_diffs(before: DataFrame, after: DataFrame, lines: int = line_diff.LINES, width: int = line_diff.CHARS) -> DataFrame:
    """path, state, diff, added, removed, truncated for each path whose content differs."""
    met = changed_paths(before, after).join(before.select("path", F.col("content").alias("was")), "path", "left").join(after.select("path", F.col("content").alias("now")), "path", "left")
    met = keep(met, "diff-pairs")
    shown = line_diff.bounded(line_diff.diff(met, "path", "was", "now"), lines, width)
    return met.select("path", "state").join(shown.withColumnRenamed("key", "path"), "path", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))
