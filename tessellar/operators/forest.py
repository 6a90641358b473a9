"""Labels of a forest, so that questions about ancestors of any depth are interval lookups.

The tour of a tree enters every node, then its children in id order, and leaves it. Places on the tour follow from sizes of subtrees:
a node is entered after its parent and all that lies under the siblings before it. Sizes, and the sums along a node's path from its
root, come by pointer doubling over parents: a round doubles how far up a node looks, so a chain of a thousand nodes takes ten rounds, trees
of four levels take two, and no tree has to fit a task. Nodes without children take no part in the rounds. Siblings are summed by a range
sort, so the children of one parent may be any number. A node is an ancestor of another where its [enter, leave) holds the other's enter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import keep
from . import intervals, scans

#: Up to so many rows (an id, another and a number each) are broadcast after they were counted. Every other join is a shuffle by
#: hint: Spark would judge tables by their compressed files and send the driver what is many times larger.
BROADCAST_ROWS = 20_000


#: Rounds beyond which a path would have more steps than a long can number.
MOST_ROUNDS = 64


def _side(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df.hint("merge")


def _rounds(inner: DataFrame) -> int:
    """A path without a cycle has fewer steps than there are nodes, and a round doubles the steps."""
    return min(MOST_ROUNDS, inner.count().bit_length() + 1)


def _sizes(inner: DataFrame) -> DataFrame:
    """inner (id, parent, size: itself and its children without children) with size: all nodes of its subtree."""
    now, rounds = keep(inner.withColumnRenamed("parent", "up"), "forest-sizes"), _rounds(inner)
    for _ in range(rounds):  # size: nodes less than 2**k steps below; up: the ancestor 2**k steps above
        below = keep(now.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("more")), "forest-below")
        n = below.count()
        if not n:
            return now.select("id", "size")
        next_up = keep(now.select("id", F.col("up").alias("next")).join(_side(below.select("id"), n), "id", "left_semi"), "forest-up")
        far = now.join(_side(below, n), "id", "left").join(_side(next_up.withColumnRenamed("id", "up"), n), "up", "left")
        now = keep(far.select("id", F.col("next").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "forest-sizes")
    raise ValueError("parent references form a cycle")


def _paths(inner: DataFrame) -> DataFrame:
    """inner (id, parent, step) with root, depth, and enter: the sum of the steps from the root to the node."""
    now, rounds = keep(inner.select("id", F.col("parent").alias("up"), F.coalesce("parent", "id").alias("root"), F.col("step").alias("enter"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")), "forest-paths"), _rounds(inner)
    for _ in range(rounds):
        asked = keep(now.where("up is not null").select(F.col("up").alias("id")).distinct(), "forest-asked")
        n = asked.count()
        if not n:
            return now.drop("up")
        far = keep(now.join(_side(asked, n), "id", "left_semi").select(F.col("id").alias("up"), F.col("up").alias("__up"), F.col("root").alias("__root"), F.col("enter").alias("__enter"), F.col("depth").alias("__depth")), "forest-far")
        met = now.join(_side(far, n), "up", "left")
        more = lambda c: (F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c)
        now = keep(met.select("id", F.col("__up").alias("up"), F.coalesce("__root", "root").alias("root"), more("enter"), more("depth")), "forest-paths")
    raise ValueError("parent references form a cycle")


def labels(nodes: DataFrame) -> DataFrame:
    """id, root, enter, leave, depth for every node (id, parent). Ids are unique; a parent that is null or not a node makes a
    root. enter and leave count within a tree, from 0. A parent reference that comes back to its own node is an error."""
    known = keep(nodes.select("id", "parent"), "forest-nodes")
    asked = keep(known.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("children")), "forest-parents")
    found = keep(known.join(_side(asked, asked.count()), "id", "left_semi").select("id", "parent"), "forest-inner")  # nodes that have children
    n = found.count()
    there = found.select(F.col("id").alias("parent"), F.lit(True).alias("__known"))
    tie = lambda df: df.join(_side(there, n), "parent", "left").select("id", F.when(F.col("__known"), F.col("parent")).alias("parent"))
    alone = keep(tie(known.join(_side(found.select("id"), n), "id", "left_anti")), "forest-leaves")
    leaves = alone.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("leaves"))
    inner = keep(tie(found), "forest-inner")
    sizes = keep(_sizes(inner.join(_side(leaves, n), "id", "left").select("id", "parent", (F.coalesce("leaves", F.lit(0)) + 1).alias("size"))), "forest-sizes")
    sized = inner.join(_side(sizes, n), "id").unionByName(alone.withColumn("size", F.lit(1).cast("long")))
    children = scans.running_sum(sized.where("parent is not null"), ["parent"], ["id"], "size", "through")
    placed = children.select("id", "parent", "size", ((F.col("through") - F.col("size")) * 2 + 1).alias("step"))  # all under the siblings before it
    placed = keep(placed.unionByName(sized.where("parent is null").withColumn("step", F.lit(0).cast("long"))), "forest-placed")
    paths = keep(_paths(placed.join(_side(found.select("id"), n), "id", "left_semi").select("id", "parent", "step")), "forest-paths")
    above = paths.select(F.col("id").alias("parent"), "root", F.col("enter").alias("__enter"), F.col("depth").alias("__depth"))
    met = placed.join(_side(above, n), "parent", "left")
    enter = F.coalesce("__enter", F.lit(0)) + F.col("step")
    return met.select("id", F.coalesce("root", "id").alias("root"), enter.alias("enter"), (enter + F.col("size") * 2 - 1).alias("leave"), F.coalesce(F.col("__depth") + 1, F.lit(0)).alias("depth"))


def enclosing(below: DataFrame, above: DataFrame, self_too: bool = False) -> DataFrame:
    """Every labelled row of ``below`` with every labelled row of ``above`` that is its ancestor (or itself): the columns of
    below, those of above with the prefix a_, and distance."""
    spans = above.select(*[F.col(c).alias(f"a_{c}" if c != "root" else c) for c in above.columns])
    met = intervals.containing(below, spans, ["root"], "enter", "a_enter", "a_leave").withColumn("distance", F.col("depth") - F.col("a_depth"))
    return met if self_too else met.where("distance > 0")


def nearest(below: DataFrame, above: DataFrame, value: Column | str, name: str, outermost: bool = False, self_too: bool = True) -> DataFrame:
    """below's id with ``name``: the value (over columns a_...) at the nearest of the ancestors in ``above``, or at the
    outermost. One running choice for each id: no list of ancestors is held."""
    met = enclosing(below, above, self_too)
    pick = F.max_by if outermost else F.min_by
    return met.groupBy("id").agg(pick(value, "distance").alias(name))


def ancestors(nodes: DataFrame) -> DataFrame:
    """id, ancestor, distance of every node with each of its ancestors, at any depth."""
    known = keep(labels(nodes), "forest")
    return enclosing(known, known).select("id", F.col("a_id").alias("ancestor"), "distance")
