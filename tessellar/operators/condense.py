"""Strongly connected components, and bounded reach of every node.

Components come from colouring: the least id is passed along edges until nothing changes; the node that has its own id as
colour is a root, and what leads back to it within its colour is its component. Edges between colours lie in no component
and are dropped, and so are those at ends of the graph, so every round works on less. A round of passing is one join and one minimum by node, combined on the map
side; rounds grow with the longest path.

Reach is worked out by balls around every node whose radius doubles, until a ball holds all that its node reaches or more than a
limit. A ball beyond the limit is not kept, and marks all that lead to it, so a set has at most limit members and rounds grow as
the logarithm of the limit, not with the longest path. Sets are arrays: at limits of some hundreds they are smaller than bitmaps
of the blocks that scattered ids touch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import keep
from .traversal import union_all


def pairs_of(edges: DataFrame) -> DataFrame:
    """Distinct (source, target) of two different known nodes."""
    return edges.where("source is not null and target is not null and source <> target").select("source", "target").distinct()


def _cyclic(edges: DataFrame) -> DataFrame:
    """Without the edges at nodes that nothing leads to, or that lead nowhere; these are components of their own, and so are
    those that come to be such without them."""
    n, before = edges.count(), -1
    while n not in (0, before):
        led = edges.select(F.col("target").alias("source")).distinct()
        leads = edges.select(F.col("source").alias("target")).distinct()
        edges = keep(edges.join(led, "source", "left_semi").join(leads, "target", "left_semi").select("source", "target"), "scc-edges")
        n, before = edges.count(), n
    return edges


def components(pairs: DataFrame) -> DataFrame:
    """id, component (an id of the component) for every node of the distinct pairs."""
    everyone = pairs.select(F.col("source").alias("id")).union(pairs.select("target")).distinct()
    left, found = _cyclic(keep(pairs, "scc-edges")), []
    while not left.isEmpty():
        ends = left.select(F.col("source").alias("id")).union(left.select("target")).distinct()
        colour = keep(ends.select("id", F.col("id").alias("colour")), "scc-colour")
        fresh = colour
        while not fresh.isEmpty():  # only nodes whose colour has changed pass it on
            told = left.join(fresh.select(F.col("id").alias("source"), "colour"), "source").groupBy(F.col("target").alias("id")).agg(F.min("colour").alias("__told"))
            met = colour.join(told, "id", "left").withColumn("__new", F.coalesce(F.col("__told") < F.col("colour"), F.lit(False)))
            both = keep(met.select("id", F.least("colour", "__told").alias("colour"), "__new"), "scc-colour")
            colour, fresh = both.drop("__new"), both.where("__new").drop("__new")
        of = lambda side: colour.select(F.col("id").alias(side), F.col("colour").alias(f"__{side}"))
        same = keep(left.join(of("source"), "source").join(of("target"), "target").where("__source = __target").select("source", "target", F.col("__source").alias("colour")), "scc-same")
        level = keep(same.select(F.col("colour").alias("id"), F.col("colour").alias("component")).distinct(), "scc-back")
        mine = [level]
        while True:  # backwards from the roots, within the colour
            met = same.join(mine[-1].select(F.col("id").alias("target")), "target").select(F.col("source").alias("id"), F.col("colour").alias("component")).distinct()
            level = keep(met.join(union_all(mine).select("id"), "id", "left_anti"), "scc-back")
            if level.isEmpty():
                break
            mine.append(level)
        found += mine
        out = union_all(mine).select("id")
        rest = same.join(out.withColumnRenamed("id", "source"), "source", "left_anti").join(out.withColumnRenamed("id", "target"), "target", "left_anti")
        left = _cyclic(keep(rest.select("source", "target"), "scc-edges"))
    if not found:
        return everyone.select("id", F.col("id").alias("component"))
    return everyone.join(union_all(found), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def balls(edges: DataFrame, limit: int) -> DataFrame:
    """id, near, front, full of every node of the edges between different nodes. near: all nodes within less than some number
    of steps, itself included; front: those at just so many. The number doubles every round while both together hold ``limit``
    nodes at most; a node that has more (or leads to one that has) is full and keeps its last ball, one of ``limit`` successors
    or more keeps itself alone. Who is not full has an empty front: near is all that it reaches.

    A node at most twice as far off is near a node of the front, so a round joins the fronts alone. Each step of a walk finds
    a new node or ends, so that a node is full or at its end after log2(limit) + 1 rounds, however long the paths are."""
    pairs = keep(pairs_of(edges), "reach-pairs")
    everyone = pairs.select(F.col("source").alias("id")).union(pairs.select("target")).distinct()
    degrees = keep(pairs.groupBy("source").agg(F.count(F.lit(1)).alias("degree")), "reach-degrees")
    narrow = degrees.where(F.col("degree") < limit).select("source")
    own = pairs.join(narrow, "source", "left_semi").groupBy(F.col("source").alias("id")).agg(F.collect_list("target").alias("front"))  # limit - 1 at most
    wide = degrees.where(F.col("degree") >= limit).select(F.col("source").alias("id"), F.lit(True).alias("full"))
    none = F.array().cast(own.schema["front"].dataType)
    state = everyone.join(own, "id", "left").join(wide, "id", "left")
    state = keep(state.select("id", F.array("id").alias("near"), F.coalesce("front", none).alias("front"), F.coalesce("full", F.lit(False)).alias("full")), "reach-state")
    while True:
        asked = state.where("not full and size(front) > 0").select("id", F.explode("front").alias("at"))
        if asked.isEmpty():
            return state
        far = state.select(F.col("id").alias("at"), F.when(~F.col("full"), F.col("near")).alias("__near"), F.when(~F.col("full"), F.col("front")).alias("__front"), F.col("full").alias("__full"))
        told = asked.join(far, "at").groupBy("id").agg(F.flatten(F.collect_list("__near")).alias("__near"), F.flatten(F.collect_list("__front")).alias("__front"), F.bool_or("__full").alias("__full"))
        met = state.join(told, "id", "left").withColumn("__near", F.when(~F.col("__full"), F.array_distinct(F.concat("near", "front", "__near"))))
        met = met.withColumn("__front", F.array_except("__front", "__near"))  # distinct
        grown = F.col("__near").isNotNull() & (F.size("__near") + F.size("__front") <= limit)
        full = F.col("full") | (F.col("__full").isNotNull() & ~grown)
        state = keep(met.select("id", F.when(grown, F.col("__near")).otherwise(F.col("near")).alias("near"), F.when(grown, F.col("__front")).otherwise(F.col("front")).alias("front"), full.alias("full")), "reach-state")


def bounded_reach(edges: DataFrame, limit: int) -> DataFrame:
    """id, reach, members: of every node the number of other nodes that it reaches, limit at most; and below the limit the
    sorted ids of all that it reaches and its own (null at the limit)."""
    return reach_of(balls(edges, limit), limit)


def reach_of(found: DataFrame, limit: int) -> DataFrame:
    """What ``bounded_reach`` returns, from its balls."""
    members = F.when(~F.col("full"), F.col("near"))
    return found.select("id", F.coalesce(F.when(~F.col("full"), F.size("near") - 1), F.lit(limit)).cast("long").alias("reach"), F.sort_array(members).alias("members"))


def whole_reach(edges: DataFrame, found: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, id: all that the seeds (id) reach, themselves included. A round jumps to the fronts of balls (``balls`` of the
    same edges), and along the edges of nodes that have too many successors for a ball."""
    pairs = pairs_of(edges)
    alone = F.col("full") & (F.size("front") == 0)
    wide = found.where(alone).select(F.col("id").alias("source"))
    wide = keep(pairs.join(wide, "source", "left_semi").select(F.col("source").alias("at"), "target"), "reach-wide")
    open_ = keep(seeds.select(F.col("id").alias("seed"), "id").distinct(), "reach-open")
    opened, met = [open_], [open_]
    while True:
        ball = open_.withColumnRenamed("id", "at").join(found.select(F.col("id").alias("at"), "near", "front", "full"), "at").where(~alone)
        ball = keep(ball.select("seed", "near", "front"), "reach-balls")
        step = open_.withColumnRenamed("id", "at").join(wide, "at").select("seed", F.col("target").alias("id"))
        met.append(ball.select("seed", F.explode(F.concat("near", "front")).alias("id")).unionByName(step))
        ends = ball.select("seed", F.explode("front").alias("id")).unionByName(step).distinct()
        open_ = keep(ends.join(union_all(opened), ["seed", "id"], "left_anti"), "reach-open")
        if open_.isEmpty():
            return union_all(met).distinct()
        opened.append(open_)


def near_reach(edges: DataFrame, limit: int, depth: int) -> DataFrame:
    """id, reach: other nodes within ``depth`` steps of every node with an edge, limit at most. Sets of limit + 2 members at
    most; a node with more successors than the limit is full at once."""
    pairs = keep(pairs_of(edges), "near-pairs")
    degrees = pairs.groupBy("source").agg(F.count(F.lit(1)).alias("degree"))
    few = keep(degrees.where(F.col("degree") <= limit).select("source"), "near-few")
    steps = keep(pairs.join(few, "source", "left_semi"), "near-steps")
    sets = steps.groupBy("source").agg(F.collect_list("target").alias("members"))  # limit at most
    sets = keep(sets.select("source", F.array_sort("members").alias("members"), F.lit(False).alias("full")).unionByName(degrees.where(F.col("degree") > limit).select("source", F.lit(None).cast(sets.schema["members"].dataType).alias("members"), F.lit(True).alias("full"))), "near-sets")
    first = sets
    for _ in range(depth - 1):
        far = sets.select(F.col("source").alias("target"), F.col("members").alias("__far"), F.col("full").alias("__full"))
        met = steps.join(far, "target").groupBy("source").agg(F.array_distinct(F.flatten(F.collect_list("__far"))).alias("__far"), F.bool_or("__full").alias("__full"))
        whole = first.join(met, "source", "left").withColumn("full", F.col("full") | F.coalesce("__full", F.lit(False)))
        whole = whole.withColumn("members", F.when(~F.col("full"), F.array_distinct(F.concat("members", F.coalesce("__far", F.array().cast(first.schema["members"].dataType))))))
        others = F.array_remove("members", F.col("source"))
        whole = whole.withColumn("members", others).withColumn("full", F.coalesce(F.col("full") | (F.size("members") >= limit), F.lit(True)))
        sets = keep(whole.select("source", F.when(~F.col("full"), F.col("members")).alias("members"), "full"), "near-sets")
    return sets.select(F.col("source").alias("id"), F.when(F.col("full"), F.lit(limit)).otherwise(F.size("members")).cast("long").alias("reach"))
