"""Bounded traversals. Walks with caps take all their seeds in one job a level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import keep

#: A cap on edges that no walk comes to.
ALL_EDGES = 2**31 - 2


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """seed, id, depth: every node that a seed reaches over source -> target edges, at its least depth (seeds at 0).
    seeds: one column, id. All seeds go in one job a level; each level is written once and earlier ones are read as they are."""
    steps = edges.select("source", "target").where("target is not null").distinct()
    levels = [seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth")).distinct()]
    while depth is None or len(levels) <= depth:
        met = levels[-1].select("seed", F.col("id").alias("source")).join(steps, "source").select("seed", F.col("target").alias("id")).distinct()
        fresh = met.join(union_all(levels).select("seed", "id"), ["seed", "id"], "left_anti")
        levels.append(keep(fresh.withColumn("depth", F.lit(len(levels))), "reach"))
        if levels[-1].isEmpty():
            break
    return union_all(levels)


def two_hops(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """target, caller, hops (1 or 2), via: who reaches the nodes of ids in one or two reverse steps."""
    step = edges.select("source", "target").where("source <> target").distinct()
    one = step.join(ids.select(F.col("id").alias("target")), "target", "left_semi")
    first = one.select("target", F.col("source").alias("caller"), F.lit(1).alias("hops"), F.col("source").alias("via"))
    second = one.select("target", F.col("source").alias("via")).join(step.select(F.col("source").alias("caller"), F.col("target").alias("via")), "via")
    second = second.where("caller <> target").join(one.select("target", F.col("source").alias("caller")), ["target", "caller"], "left_anti")
    second = second.groupBy("target", "caller").agg(F.min("via").alias("via")).select("target", "caller", F.lit(2).alias("hops"), "via")
    return first.unionByName(second)



@dataclass
class Walk:
    """nodes: seed, id, depth, place. edges: seed, place, depth, and the columns of the edges walked. cut: seeds whose walk
    left something out."""

    nodes: DataFrame
    edges: DataFrame
    cut: DataFrame


def ranked_of_source(edges: DataFrame, n: int) -> DataFrame:
    """The first n edges of every source in id order, with their __rank; Spark cuts each source on the map side first."""
    return edges.withColumn("__rank", F.row_number().over(Window.partitionBy("source").orderBy("id"))).where(F.col("__rank") <= n)


def first_of_source(edges: DataFrame, n: int) -> DataFrame:
    """The first n edges of every source in id order."""
    return ranked_of_source(edges, n).drop("__rank")


def capped_walk(edges: DataFrame, seeds: DataFrame, depth: int, max_nodes: int, max_edges: int, drop_past_nodes: bool = False) -> Walk:
    """Breadth-first walks from every seed, with caps whose effect depends on visit order.

    edges: id, source, target (null where unknown), any more. Nodes are visited in the order in which they were found, the
    edges of each in id order. A walk ends at max_edges edges. A new target beyond max_nodes is not visited; its edge is
    kept, or with ``drop_past_nodes`` left out. At the last level any further edge only marks the walk as cut.

    Of a node at most max_edges + 1 edges are looked at, and a walk never holds more than max_nodes nodes, so that the rows
    of a seed on a level are bounded; they are ranked in one window by seed. Where every edge counts, the number of edges of
    the nodes before it tells which edges of a node can still have a place: a seed meets no more than are left, and one.
    """
    seed = keep(seeds.select(F.col("id").alias("seed")).distinct(), "walk-seeds")
    nodes = [seed.select("seed", F.col("seed").alias("id"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("place"))]
    kept: list[DataFrame] = []
    cut: list[DataFrame] = []
    near = keep(ranked_of_source(edges, max_edges + 1), "walk-edges")
    degrees = keep(near.groupBy("source").agg(F.max("__rank").alias("__degree")), "walk-degrees")
    columns = edges.columns
    for level in range(depth + 1):
        front = nodes[-1].select("seed", F.col("id").alias("source"), F.col("place").alias("__at"))
        if level == depth:
            cut.append(front.join(degrees, "source", "left_semi").select("seed"))
            break
        seen = union_all(nodes).select("seed", F.col("id").alias("target"), F.lit(True).alias("__seen"))
        sums = seen.groupBy("seed").agg(F.count(F.lit(1)).alias("__nodes"))
        if kept:
            sums = sums.join(union_all([k.select("seed") for k in kept]).groupBy("seed").agg(F.count(F.lit(1)).alias("__edges")), "seed", "left")
        else:
            sums = sums.withColumn("__edges", F.lit(0).cast("long"))
        sums = sums.fillna(0, ["__edges"])
        if drop_past_nodes or max_edges >= ALL_EDGES:
            met = front.join(near, "source").join(sums, "seed")
        else:
            ahead = F.sum("__degree").over(Window.partitionBy("seed").orderBy("__at")) - F.col("__degree")
            room = F.lit(max_edges) - F.col("__edges") - F.col("__ahead")
            open_ = front.join(degrees, "source").join(sums, "seed").withColumn("__ahead", ahead).withColumn("__room", room).where("__room >= 0")
            met = open_.drop("__degree", "__ahead").join(near, "source").where("__rank <= __room + 1").drop("__room")
        met = met.drop("__rank").join(seen, ["seed", "target"], "left")
        order = Window.partitionBy("seed").orderBy("__at", "id")
        same = Window.partitionBy("seed", "target")
        fresh = F.col("target").isNotNull() & F.col("__seen").isNull()
        met = met.withColumn("__first", fresh & (F.row_number().over(same.orderBy("__at", "id")) == 1))
        met = met.withColumn("__found", F.col("__nodes") + F.sum(F.col("__first").cast("int")).over(order))
        found = F.when(fresh, F.min(F.when(F.col("__first"), F.col("__found"))).over(same)).otherwise(0)
        met = met.withColumn("__inside", found <= max_nodes)
        counts = F.col("__inside") if drop_past_nodes else F.lit(True)
        met = met.withColumn("__place", F.col("__edges") + F.sum(counts.cast("int")).over(order)).withColumn("__counts", counts)
        met = keep(met, "walk-level")
        within = F.col("__counts") & (F.col("__place") <= max_edges)
        cut.append(met.where(~within | ~F.col("__inside")).select("seed"))
        kept.append(met.where(within).select("seed", F.col("__place").alias("place"), F.lit(level).alias("depth"), *columns))
        nodes.append(met.where(within & F.col("__first") & F.col("__inside")).select("seed", F.col("target").alias("id"), F.lit(level + 1).alias("depth"), (F.col("__found") - 1).alias("place")))
        if nodes[-1].isEmpty():
            break
    return Walk(union_all(nodes), union_all(kept), union_all(cut).distinct())


def trace(edges: DataFrame, seeds: DataFrame, depth: int = 2, limit: int = 100, incoming: bool = False) -> Walk:
    """Callees, or callers, of every seed: at most ``limit`` nodes and 5 * limit edges; an edge whose new node is beyond the
    node cap is left out. Edges of unknown target are kept. Nodes and edges of the result are those of ``edges``."""
    other = {"source": "target", "target": "source"} if incoming else {}
    turned = lambda df: df.select(*[F.col(other.get(c, c)).alias(c) for c in df.columns])
    found = capped_walk(turned(edges), seeds, depth, limit, 5 * limit, drop_past_nodes=True)
    return Walk(found.nodes, turned(found.edges), found.cut)


def reach_capped(edges: DataFrame, seeds: DataFrame, limit: int = 400, depth: int = 64) -> Walk:
    """Up to ``limit`` other nodes that each seed reaches, in visit order; exact where a seed reaches fewer."""
    one = edges.where("target is not null").groupBy("source", "target").agg(F.min("id").alias("id"))
    return capped_walk(one, seeds, depth, limit + 1, ALL_EDGES)


def impact(edges: DataFrame, seeds: DataFrame, limit: int = 30) -> tuple[DataFrame, DataFrame]:
    """(seed, place, caller, hops, via; cut seeds): who reaches each seed in one or two reverse steps, at most ``limit`` of
    them, each with the edge ids of its path. Callers are visited in the order found. A caller that a later one calls back
    is named again, once for every edge from a node that has not been visited yet."""
    calls = edges.where("target is not null").select(F.col("target").alias("source"), F.col("source").alias("caller"), "id")
    calls = keep(first_of_source(calls, limit + 1), "impact-edges")
    one = seeds.select(F.col("id").alias("seed")).distinct().join(calls, F.col("seed") == F.col("source")).where("caller <> seed")
    order = Window.partitionBy("seed")
    one = keep(one.withColumn("place", F.row_number().over(order.orderBy("id"))), "impact-one")
    first = one.where(F.col("place") <= limit)
    over = one.where(F.col("place") > limit).select("seed").distinct()
    queue = keep(first.groupBy("seed", "caller").agg(F.min(F.struct("place", "id")).alias("q")).select("seed", F.col("caller").alias("node"), F.col("q.place").alias("at"), F.col("q.id").alias("step")), "impact-queue")
    held = first.groupBy("seed").agg(F.count(F.lit(1)).alias("held"))
    before = queue.select("seed", F.col("node").alias("caller"), F.col("at").alias("visited"))
    two = queue.join(over, "seed", "left_anti").join(calls, F.col("node") == F.col("source")).where("caller <> seed")
    two = two.join(before, ["seed", "caller"], "left").where("visited is null or visited > at").join(held, "seed")
    two = keep(two.withColumn("place", F.col("held") + F.row_number().over(order.orderBy("at", "id"))), "impact-two")
    second = two.where(F.col("place") <= limit)
    last = second.where("visited is null").groupBy("seed", "caller").agg(F.min("place").alias("at"))
    seen = before.unionByName(last.select("seed", "caller", F.col("at").alias("visited")))
    more = last.withColumnRenamed("caller", "node").join(calls, F.col("node") == F.col("source")).where("caller <> seed")
    more = more.join(seen, ["seed", "caller"], "left").where("visited is null or visited > at").select("seed")
    rows = first.select("seed", F.col("place").cast("long").alias("place"), "caller", F.lit(1).alias("hops"), F.array("id").alias("via"))
    rows = rows.unionByName(second.select("seed", "place", "caller", F.lit(2).alias("hops"), F.array("step", "id").alias("via")))
    full = two.where(F.col("place") > limit).select("seed")
    return rows, over.unionByName(full).unionByName(more.join(full.distinct(), "seed", "left_anti")).distinct()


def routes(edges: DataFrame, seeds: DataFrame, depth: int = 6, fan_out: int = 6, limit: int = 64) -> tuple[DataFrame, DataFrame]:
    """(seed, place, route; cut seeds): paths along edges in depth-first order, as node arrays. A path ends where nothing
    leaves, at ``depth`` edges, or with the edge that comes back to a node of its own. Of a node the first ``fan_out``
    edges are followed. Paths of a level are cut to the first ``limit``: each has at least one end, so no more can count."""
    by_source = Window.partitionBy("source").orderBy("id")
    step = edges.where("target is not null").select("source", "target", F.row_number().over(by_source).alias("rank"))
    step = keep(step.where(F.col("rank") <= fan_out + 1), "route-edges")
    more = step.where(F.col("rank") > fan_out).select(F.col("source").alias("node")).distinct()
    follow = step.where(F.col("rank") <= fan_out)
    has = follow.select(F.col("source").alias("node")).distinct()
    start = F.col("id")
    open_paths = seeds.select(start.alias("seed"), start.alias("node"), F.array(start).alias("route"), F.array().cast("array<int>").alias("ranks")).distinct()
    ends: list[DataFrame] = []
    cut: list[DataFrame] = []
    first = Window.partitionBy("seed").orderBy("ranks")
    for level in range(depth + 1):
        stuck = open_paths.join(has, "node", "left_anti")
        if level == depth:
            cut.append(open_paths.join(has, "node", "left_semi").select("seed"))
            stuck = open_paths
        ends.append(stuck.select("seed", "route", "ranks"))
        if level == depth:
            break
        cut.append(open_paths.join(more, "node", "left_semi").select("seed"))
        met = open_paths.join(follow, F.col("node") == F.col("source"))
        met = met.withColumn("again", F.array_contains("route", F.col("target")))
        met = met.select("seed", F.col("target").alias("node"), F.concat("route", F.array("target")).alias("route"), F.concat("ranks", F.array("rank")).alias("ranks"), "again")
        met = keep(met.withColumn("__place", F.row_number().over(first)).where(F.col("__place") <= limit + 1), "routes")
        cut.append(met.where(F.col("__place") > limit).select("seed"))
        met = met.where(F.col("__place") <= limit).drop("__place")
        ends.append(met.where("again").select("seed", "route", "ranks"))
        open_paths = met.where("not again").drop("again")
        if open_paths.isEmpty():
            break
    placed = union_all(ends).withColumn("place", F.row_number().over(first))
    cut.append(placed.where(F.col("place") > limit).select("seed"))
    return placed.where(F.col("place") <= limit).select("seed", "place", "route"), union_all(cut).distinct()


def first_above(start: DataFrame, parents: DataFrame, wanted: DataFrame, hops: int) -> DataFrame:
    """start (id) with the value of the nearest node, itself first, that is in wanted (id, value); at most ``hops`` steps
    along parents (id, parent), of which each node has one. Null where none is found."""
    level = start.select("id", F.col("id").alias("at")).distinct()
    found = []
    for k in range(hops + 1):
        met = level.join(wanted.select(F.col("id").alias("at"), "value"), "at", "left")
        found.append(met.where("value is not null").select("id", "value", F.lit(k).alias("distance")))
        rest = met.where("value is null").select("id", "at")
        level = keep(rest.join(parents.select(F.col("id").alias("at"), "parent"), "at").select("id", F.col("parent").alias("at")), "above")
    return start.select("id").distinct().join(union_all(found), "id", "left").select("id", "value", "distance")


def expanded(start: DataFrame, children: DataFrame, depth: int) -> DataFrame:
    """seed, path, depth, again: the tree of nodes below every start node (id) along children (parent, child) to a depth.
    A child that stands on its own path is shown once more (again) and not opened."""
    level = start.select(F.col("id").alias("seed"), F.array("id").alias("path"), F.lit(0).alias("depth"), F.lit(False).alias("again")).distinct()
    out = [level]
    for k in range(1, depth + 1):
        met = level.where("not again").join(children, F.element_at("path", -1) == F.col("parent"))
        level = keep(met.select("seed", F.concat("path", F.array("child")).alias("path"), F.lit(k).alias("depth"), F.array_contains("path", F.col("child")).alias("again")), "expanded")
        out.append(level)
    return union_all(out)


def neighbourhoods(edges: DataFrame, entries: DataFrame, depth: int = 2, max_nodes: int = 9, queue_limit: int = 12, calls: int = 24, questions: int = 4) -> DataFrame:
    """seed, visited, unknown (ids of unresolved calls), cut around the first three entries (seed, place, id) of every seed.

    edges: id, source, target, resolution, start_byte. Of a node the first ``calls`` edges by id are followed in start_byte
    order; a target waits while fewer than ``queue_limit`` do. What waits is one level of one seed, at most queue_limit nodes:
    a level is one job for all seeds, which brings the edges of all that wait and folds them into each seed's state in order.
    """
    node, edge = entries.schema["id"].dataType.simpleString(), edges.schema["id"].dataType.simpleString()
    kind = f"struct<waiting:array<struct<id:{node},place:int>>,visited:array<{node}>,unknown:array<{edge}>,cut:boolean,over:boolean>"
    few = first_of_source(edges, calls + 1)
    steps = F.sort_array(F.collect_list(F.struct("__k", "start_byte", "id", "target", "resolution")))
    ranked = few.withColumn("__k", F.row_number().over(Window.partitionBy("source").orderBy("id"))).groupBy("source").agg(steps.alias("steps"))
    ranked = keep(ranked.select("source", F.array_sort(F.transform(F.slice("steps", 1, calls), lambda x: F.struct(x["start_byte"].alias("start_byte"), x["id"].alias("id"), x["target"].alias("target"), x["resolution"].alias("resolution")))).alias("steps"), (F.size("steps") > calls).alias("more")), "near-edges")
    first = entries.withColumn("__p", F.row_number().over(Window.partitionBy("seed").orderBy("place"))).where("__p <= 4")
    begun = first.groupBy("seed").agg(F.sort_array(F.collect_list(F.struct(F.col("__p").alias("place"), "id"))).alias("e"))
    start = F.struct(
        F.transform(F.slice("e", 1, 3), lambda x: F.struct(x["id"].alias("id"), x["place"].alias("place"))).alias("waiting"), F.array().cast(f"array<{node}>").alias("visited"),
        F.array().cast(f"array<{edge}>").alias("unknown"), (F.size("e") > 3).alias("cut"), F.lit(False).alias("over"),
    ).cast(kind)
    state = keep(begun.select("seed", start.alias("s")), "near-state")
    for level in range(depth + 1):
        asked = state.where("not s.over").select("seed", F.size("s.waiting").alias("__n"), F.explode("s.waiting").alias("w")).select("seed", "__n", "w.place", F.col("w.id").alias("source"))
        met = asked.join(ranked, "source", "left")
        items = met.groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("place", "source", "steps", F.coalesce("more", F.lit(False)).alias("more"), "__n"))).alias("items"))

        def followed(s: Column, x: Column) -> Column:
            """The state after the edges of one node; __n - place nodes of its level still wait."""

            def one(t: Column, e: Column) -> Column:
                room = F.size(t["waiting"]) + x["__n"] - x["place"] < queue_limit
                known = e["target"].isNotNull()
                asks = ~known & (e["resolution"] != "external") & (F.size(t["unknown"]) < questions)
                added = F.concat(t["waiting"], F.array(F.struct(e["target"].cast(node).alias("id"), (F.size(t["waiting"]) + 1).alias("place"))))
                return F.struct(
                    F.when(known & room, added).otherwise(t["waiting"]).alias("waiting"), t["visited"].alias("visited"),
                    F.when(asks, F.concat(t["unknown"], F.array(e["id"]))).otherwise(t["unknown"]).alias("unknown"), (t["cut"] | (known & ~room)).alias("cut"), t["over"].alias("over"),
                ).cast(kind)

            seen = F.struct(s["waiting"].alias("waiting"), F.concat(s["visited"], F.array(x["source"])).alias("visited"), s["unknown"].alias("unknown"), s["cut"].alias("cut"), s["over"].alias("over")).cast(kind)
            own = F.coalesce(x["steps"], F.array().cast(ranked.schema["steps"].dataType))
            if level == depth:
                return F.struct(seen["waiting"].alias("waiting"), seen["visited"].alias("visited"), seen["unknown"].alias("unknown"), (seen["cut"] | (F.size(own) > 0)).alias("cut"), seen["over"].alias("over")).cast(kind)
            after = F.aggregate(own, seen, one)
            return F.struct(after["waiting"].alias("waiting"), after["visited"].alias("visited"), after["unknown"].alias("unknown"), (after["cut"] | x["more"]).alias("cut"), after["over"].alias("over")).cast(kind)

        def popped(s: Column, x: Column) -> Column:
            full = F.struct(s["waiting"].alias("waiting"), s["visited"].alias("visited"), s["unknown"].alias("unknown"), F.lit(True).alias("cut"), F.lit(True).alias("over")).cast(kind)
            again = F.array_contains(s["visited"], x["source"])
            return F.when(s["over"] | again, s).when(F.size(s["visited"]) >= max_nodes, full).otherwise(followed(s, x))

        emptied = F.struct(F.array().cast(f"array<struct<id:{node},place:int>>").alias("waiting"), F.col("s.visited").alias("visited"), F.col("s.unknown").alias("unknown"), F.col("s.cut").alias("cut"), F.col("s.over").alias("over")).cast(kind)
        folded = state.join(items, "seed", "left").withColumn("s", F.when(F.col("items").isNull(), emptied).otherwise(F.aggregate(F.coalesce("items", F.array().cast(items.schema["items"].dataType)), emptied, popped)))
        state = keep(folded.select("seed", "s"), "near-state")
    return state.select("seed", "s.visited", "s.unknown", "s.cut")
