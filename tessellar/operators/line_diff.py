"""Line differences of many pairs of texts, as joins and groupings.

Lines of both versions that match are found in rounds. A gap is what lies between two matches that follow one another. A
round matches the equal lines that a gap begins with, then those that it ends with, then anchors: lines that stand
once on each side of the gap, of which the longest run that rises on both sides is kept. Anchors part a gap into smaller
ones, where other lines are unique. It ends when no gap finds anything; what is left is removed or added. Applying the result to
the first text gives the second. Lines are parted by \\n, and the last one needs none; a null text is empty. A pair is as large as
its two texts, which were one row each; nothing larger is held together.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import keep
from .traversal import union_all

#: What a report shows of a file: lines, characters of a line, and lines around a change.
LINES, CHARS, CONTEXT = 160, 800, 3


def rising(other: np.ndarray) -> np.ndarray:
    """Of places in order of the first side, which lie on a longest rising run of the second."""
    tails: list[int] = []
    at: list[int] = []
    before = np.full(len(other), -1)
    for k, b in enumerate(other.tolist()):
        n = bisect_left(tails, b)
        tails[n : n + 1] = [b]
        at[n : n + 1] = [k]
        before[k] = at[n - 1] if n else -1
    kept = np.zeros(len(other), bool)
    k = at[-1] if at else -1
    while k >= 0:
        kept[k] = True
        k = before[k]
    return kept


def lines_of(texts: DataFrame, key: str, text: str, side: str) -> DataFrame:
    """key, side, pos, line of every line."""
    whole = F.coalesce(F.col(text), F.lit(""))
    parts = F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(F.when(whole.endswith("\n"), F.substr(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole), "\n"))
    return texts.select(F.col(key).alias("key"), F.lit(side).alias("side"), F.posexplode(parts).alias("pos", "line"))


def _gaps(lines: DataFrame, matched: DataFrame) -> DataFrame:
    """Lines without a match, with the number of their gap (matches before it) and their place from both of its ends."""
    sides = union_all([matched.select("key", F.lit(s).alias("side"), F.col(s).alias("pos"), F.lit(1).alias("__hit")) for s in ("a", "b")])
    met = lines.join(sides, ["key", "side", "pos"], "left")
    run = Window.partitionBy("key", "side").orderBy("pos")
    open_lines = met.withColumn("gap", F.count("__hit").over(run)).where("__hit is null").drop("__hit")
    own = Window.partitionBy("key", "side", "gap").orderBy("pos")
    size = F.count(F.lit(1)).over(Window.partitionBy("key", "side", "gap"))
    return open_lines.withColumn("front", F.row_number().over(own)).withColumn("back", size - F.col("front") + 1)


def _ends(gaps: DataFrame, place: str) -> DataFrame:
    """Matches of the lines that gaps begin (front) or end (back) with."""
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    beside = gaps.groupBy("key", "gap", place).agg(side("a", "pos").alias("a"), side("b", "pos").alias("b"), side("a", "line").alias("x"), side("b", "line").alias("y"))
    differ = F.min(F.when(~F.col("x").eqNullSafe(F.col("y")), F.col(place))).over(Window.partitionBy("key", "gap"))
    return beside.withColumn("__end", differ).where(F.col("__end").isNull() | (F.col(place) < F.col("__end"))).select("key", "a", "b")


def _anchors(gaps: DataFrame) -> DataFrame:
    """Matches of lines that stand once on both sides of their gap, without those that cross."""
    on = lambda s: F.count_if(F.col("side") == s)
    place = lambda s: F.max(F.when(F.col("side") == s, F.col("pos")))
    once = gaps.groupBy("key", "gap", "line").agg(on("a").alias("n"), on("b").alias("m"), place("a").alias("a"), place("b").alias("b")).where("n = 1 and m = 1")
    lists = once.groupBy("key", "gap").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("pairs"))  # lines of one text

    @F.pandas_udf("array<boolean>")
    def on_run(other: pd.Series) -> pd.Series:
        return pd.Series([rising(np.asarray(x)).tolist() for x in other])

    found = lists.withColumn("on", on_run(F.transform("pairs", lambda p: p["b"])))
    return found.select("key", F.explode(F.filter(F.arrays_zip("pairs", "on"), lambda p: p["on"])).alias("p")).select("key", "p.pairs.a", "p.pairs.b")


def diff(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """key, place, op (' ' kept, '-' removed, '+' added), line of every pair whose texts differ, in the order of a patch."""
    changed = pairs.where(~F.coalesce(before, F.lit("")).eqNullSafe(F.coalesce(after, F.lit(""))))
    lines = keep(lines_of(changed, key, before, "a").unionByName(lines_of(changed, key, after, "b")), "diff-lines")
    matched = keep(lines.where("side = 'a'").select("key", F.col("pos").alias("a"), F.col("pos").alias("b")).limit(0), "diff-matches")
    idle, step = 0, 0
    while idle < 3:
        gaps = _gaps(lines, matched)
        fresh = keep(_anchors(gaps) if step % 3 == 2 else _ends(gaps, ("front", "back")[step % 3]), "diff-matches")
        idle = idle + 1 if fresh.isEmpty() else 0
        matched = keep(matched.unionByName(fresh), "diff-matches") if not idle else matched
        step += 1
    gap = Window.partitionBy("key").orderBy("a")
    kept = matched.withColumn("gap", F.row_number().over(gap) - 1).join(lines.where("side = 'a'").select("key", F.col("pos").alias("a"), "line"), ["key", "a"])
    ops = kept.select("key", "gap", F.lit(2).alias("turn"), F.col("a").alias("pos"), F.lit(" ").alias("op"), "line")
    rest = _gaps(lines, matched).select("key", "gap", F.when(F.col("side") == "a", 0).otherwise(1).alias("turn"), "pos", F.when(F.col("side") == "a", "-").otherwise("+").alias("op"), "line")
    order = Window.partitionBy("key").orderBy("gap", "turn", "pos")
    return ops.unionByName(rest).withColumn("place", F.row_number().over(order)).select("key", "place", "op", "line")


def bounded(ops: DataFrame, lines: int = LINES, chars: int = CHARS, context: int = CONTEXT) -> DataFrame:
    """key, diff (an array of lines: @@ where something is left out, then op and text), added, removed, truncated: what a report
    shows, changes with ``context`` lines around them, cut after ``lines`` lines and ``chars`` characters of a line."""
    back, on = Window.partitionBy("key").orderBy("place"), Window.partitionBy("key").orderBy(F.desc("place"))
    change = F.when(F.col("op") != " ", F.col("place"))
    near = ops.withColumn("__last", F.last(change, True).over(back)).withColumn("__next", F.last(change, True).over(on))
    near = near.where((F.col("place") - F.col("__last") <= context) | (F.col("__next") - F.col("place") <= context))
    cut = F.coalesce(F.col("place") - F.lag("place").over(back), F.col("place")) > 1
    shown = near.withColumn("__hunk", cut.cast("int")).withColumn("__row", F.row_number().over(back) + F.sum(F.col("__hunk")).over(back))
    row = F.concat("op", F.substring("line", 1, chars))
    few = shown.where(F.col("__row") <= lines + 1)
    parts = few.withColumn("__text", F.when(cut, F.array(F.lit("@@"), row)).otherwise(F.array(row)))
    sums = ops.groupBy("key").agg(F.count_if(F.col("op") == "+").alias("added"), F.count_if(F.col("op") == "-").alias("removed"))
    whole = parts.groupBy("key").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", "__text"))), lambda x: x["__text"])).alias("diff"),
        F.max(F.length("line") > chars).alias("__wide"), F.max("__row").alias("__rows"),
    )
    long = shown.groupBy("key").agg(F.max("__row").alias("__all"))
    return whole.join(long, "key").join(sums, "key").select("key", F.slice("diff", 1, lines).alias("diff"), "added", "removed", (F.col("__wide") | (F.col("__all") > lines)).alias("truncated"))


def patched(ops: DataFrame) -> DataFrame:
    """key, before, after: the two line lists that a patch tells of."""
    side = lambda gone: F.transform(F.sort_array(F.collect_list(F.when(F.col("op") != gone, F.struct("place", "line")))), lambda x: x["line"])
    return ops.groupBy("key").agg(side("+").alias("before"), side("-").alias("after"))
