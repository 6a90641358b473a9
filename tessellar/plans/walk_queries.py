"""Capped walks over the call graph of the events, from every user at once.

The SQL writes a walk level by level with the same order and caps; tests hold the operators against plain searches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, condense, traversal
from ..storage import keep
from .registry import query
from .views import CALLS_SQL, calls

WITH_C = f"WITH RECURSIVE {CALLS_SQL.strip()}"


def walk_sql(edges: str, seeds: str, depth: int, max_nodes: int, max_edges: int, drop: bool) -> str:
    """CTEs nodes_, kept_ and cut_ of a capped walk over ``edges`` (id, source, target) from ``seeds`` (seed)."""
    both = lambda name, n: " UNION ALL ".join(f"SELECT * FROM {name}{k}" for k in range(n))
    out = [
        f"near_ AS MATERIALIZED (SELECT id, source, target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS rk FROM {edges}) WHERE rk <= {max_edges + 1})",
        f"n0 AS (SELECT DISTINCT seed, seed AS id, 0 AS depth, CAST(0 AS BIGINT) AS place FROM {seeds})",
    ]
    for k in range(depth):
        edges_so_far = f"(SELECT seed, count(*) AS ne FROM ({both('k', k)}) GROUP BY seed)" if k else "(SELECT NULL AS seed, 0 AS ne)"
        out += [
            f"seen{k} AS MATERIALIZED ({both('n', k + 1)})",
            f"""m{k} AS MATERIALIZED (SELECT n.seed, n.place AS pos_, e.*, s.id IS NOT NULL AS seen, c.nn, coalesce(q.ne, 0) AS ne FROM n{k} n JOIN near_ e ON n.id = e.source
  LEFT JOIN seen{k} s ON s.seed = n.seed AND s.id = e.target JOIN (SELECT seed, count(*) AS nn FROM seen{k} GROUP BY seed) c ON c.seed = n.seed LEFT JOIN {edges_so_far} q ON q.seed = n.seed)""",
            f"f{k} AS (SELECT *, target IS NOT NULL AND NOT seen AND row_number() OVER (PARTITION BY seed, target ORDER BY pos_, id) = 1 AS first_ FROM m{k})",
            f"g{k} AS (SELECT *, nn + sum(CAST(first_ AS INTEGER)) OVER (PARTITION BY seed ORDER BY pos_, id) AS found FROM f{k})",
            f"h{k} AS (SELECT *, target IS NULL OR seen OR min(CASE WHEN first_ THEN found END) OVER (PARTITION BY seed, target) <= {max_nodes} AS inside FROM g{k})",
            f"i{k} AS MATERIALIZED (SELECT *, ne + sum(CAST({'inside' if drop else 'true'} AS INTEGER)) OVER (PARTITION BY seed ORDER BY pos_, id) AS pl FROM h{k})",
            f"w{k} AS (SELECT *, {'inside AND' if drop else ''} pl <= {max_edges} AS within FROM i{k})",
            f"k{k} AS (SELECT seed, CAST(pl AS BIGINT) AS place, {k} AS depth, id, source, target FROM w{k} WHERE within)",
            f"n{k + 1} AS (SELECT seed, target AS id, {k + 1} AS depth, CAST(found - 1 AS BIGINT) AS place FROM w{k} WHERE within AND first_ AND inside)",
        ]
    cuts = "".join(f"SELECT seed FROM w{k} WHERE NOT within OR NOT inside UNION " for k in range(depth))
    out += [f"nodes_ AS ({both('n', depth + 1)})", f"kept_ AS ({both('k', depth)})", f"cut_ AS ({cuts}SELECT n.seed FROM n{depth} n JOIN near_ e ON n.id = e.source)"]
    return ", ".join(out)


SEEDS = "(SELECT source AS seed FROM calls)"


def sources(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("id")).distinct()


@query(f"""{WITH_C}, {walk_sql('calls', SEEDS, 2, 20, 100, True)}
SELECT k.seed, k.place, k.depth, k.source, k.target, c.seed IS NOT NULL AS truncated FROM kept_ k LEFT JOIN cut_ c ON k.seed = c.seed""")
def trace_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call neighbourhood of every user: two levels, 20 nodes and 100 edges."""
    edges = keep(calls(spark, sf_dir), "calls")
    found = traversal.trace(edges, sources(edges), 2, 20)
    return found.edges.select("seed", "place", "depth", "source", "target").join(found.cut.withColumn("cut", F.lit(True)), "seed", "left").select(
        "seed", "place", "depth", "source", "target", F.coalesce("cut", F.lit(False)).alias("truncated")
    )


@query(f"""{WITH_C}, turned AS (SELECT id, target AS source, source AS target FROM calls WHERE target IS NOT NULL), {walk_sql('turned', '(SELECT source AS seed FROM turned)', 2, 20, 100, True)}
SELECT seed, id AS caller, depth, place FROM nodes_""")
def trace_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The callers of every user, in the order in which they are found."""
    edges = calls(spark, sf_dir)
    seeds = edges.where("target is not null").select(F.col("target").alias("id"))
    return traversal.trace(edges.where("target is not null"), seeds, 2, 20, incoming=True).nodes.select("seed", F.col("id").alias("caller"), "depth", "place")


SCENARIO_SQL = f"{WITH_C}, {walk_sql('calls', SEEDS, 3, 60, 120, False)}"


@query(f"""{SCENARIO_SQL}, met AS (SELECT k.*, c.resolution FROM kept_ k JOIN calls c USING (id))
SELECT seed, any_value(n.nodes) AS nodes, count(*) AS edges, count(*) FILTER (target IS NULL AND resolution <> 'external') AS unknown,
  count(*) FILTER (target IS NULL AND resolution = 'external') AS external, bool_or(c.seed IS NOT NULL) AS truncated, string_agg(CAST(id AS VARCHAR), ',' ORDER BY place) AS steps
FROM met LEFT JOIN (SELECT DISTINCT seed FROM cut_) c USING (seed) JOIN (SELECT seed, count(*) AS nodes FROM nodes_ GROUP BY seed) n USING (seed) GROUP BY seed""")
def scenario_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's scenario in one walk: depth 3, 60 nodes, 120 edges, with its unknown breakpoints and external boundaries."""
    edges = keep(calls(spark, sf_dir), "calls")
    found = traversal.capped_walk(edges, sources(edges), 3, 60, 120)
    steps = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"].cast("string")), ",")  # at most 120 edges
    out = found.edges.groupBy("seed").agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(F.col("target").isNull() & (F.col("resolution") != "external")).alias("unknown"),
        F.count_if(F.col("target").isNull() & (F.col("resolution") == "external")).alias("external"), steps.alias("steps"),
    )
    sizes = found.nodes.groupBy("seed").agg(F.count(F.lit(1)).alias("nodes"))
    flag = found.cut.withColumn("truncated", F.lit(True))
    return out.join(sizes, "seed").join(flag, "seed", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


@query(f"""{WITH_C}, tests AS (SELECT DISTINCT source AS seed FROM calls WHERE kind = 'error'), {walk_sql('calls', 'tests', 3, 60, 120, False)},
reached AS (SELECT DISTINCT seed, id // 10 AS component FROM nodes_ WHERE id <> seed)
SELECT component, count(*) AS tests, CAST(sum(u.unknown) AS BIGINT) AS unknown FROM reached JOIN (SELECT seed, count(*) FILTER (target IS NULL) AS unknown FROM kept_ GROUP BY seed) u USING (seed) GROUP BY component""")
def test_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components by the tests (users before an error) whose walk reaches them, and the unknown calls of those walks."""
    edges = keep(calls(spark, sf_dir), "calls")
    found = traversal.capped_walk(edges, sources(edges.where("kind = 'error'")), 3, 60, 120)
    reached = found.nodes.where("id <> seed").select("seed", F.expr("id div 10").alias("component")).distinct()
    unknown = found.edges.groupBy("seed").agg(F.count_if(F.col("target").isNull()).alias("unknown"))
    return reached.join(unknown, "seed").groupBy("component").agg(F.count(F.lit(1)).alias("tests"), F.sum("unknown").alias("unknown"))


IMPACT_SQL = f"""{WITH_C}, rev AS MATERIALIZED (SELECT * FROM (SELECT target AS node, source AS caller, id, row_number() OVER (PARTITION BY target ORDER BY id) AS rk FROM calls WHERE target IS NOT NULL) WHERE rk <= 31),
one AS MATERIALIZED (SELECT seed, caller, id, row_number() OVER (PARTITION BY seed ORDER BY id) AS place FROM (SELECT DISTINCT target AS seed FROM calls WHERE target IS NOT NULL) JOIN rev ON seed = node WHERE caller <> seed),
q AS MATERIALIZED (SELECT seed, caller AS node, min(place) AS at, arg_min(id, place) AS step, max(place) AS held FROM one WHERE place <= 30 GROUP BY seed, caller),
open_ AS (SELECT q.*, max(held) OVER (PARTITION BY seed) AS n FROM q WHERE seed NOT IN (SELECT seed FROM one WHERE place > 30)),
two AS MATERIALIZED (SELECT o.seed, r.caller, r.id, o.step, o.n + row_number() OVER (PARTITION BY o.seed ORDER BY o.at, r.id) AS place
  FROM open_ o JOIN rev r ON o.node = r.node LEFT JOIN q ON q.seed = o.seed AND q.node = r.caller WHERE r.caller <> o.seed AND (q.at IS NULL OR q.at > o.at))"""


@query(f"""{IMPACT_SQL} SELECT seed, place, caller, 1 AS hops, CAST(id AS VARCHAR) AS via FROM one WHERE place <= 30
UNION ALL SELECT seed, place, caller, 2, step || '>' || id FROM two WHERE place <= 30""")
def impact_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 30 callers of every user within two hops, each with its path."""
    edges = calls(spark, sf_dir)
    found, _ = traversal.impact(edges, edges.where("target is not null").select(F.col("target").alias("id")))
    return found.withColumn("via", F.array_join(F.transform("via", lambda x: x.cast("string")), ">"))


REACH_SQL = f"""{WITH_C}, pairs AS MATERIALIZED (SELECT DISTINCT source, target FROM calls WHERE target IS NOT NULL),
r(seed, id) AS (SELECT source, target FROM pairs UNION SELECT r.seed, p.target FROM r JOIN pairs p ON r.id = p.source),
reach AS MATERIALIZED (SELECT seed, least(count(*), 400) AS reach FROM r WHERE id <> seed GROUP BY seed)"""


def reach_sizes(edges: DataFrame) -> DataFrame:
    """seed, reach: up to 400 other users that each user reaches."""
    return condense.bounded_reach(edges, 400).where("reach > 0").select(F.col("id").alias("seed"), "reach")


@query(f"{REACH_SQL} SELECT seed, reach FROM reach")
def reach_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach_sizes(calls(spark, sf_dir))


@query(f"""{REACH_SQL}, handlers AS (SELECT source AS seed, count(*) AS routes, min(id) AS first_at FROM calls WHERE kind = 'view' GROUP BY source),
c AS (SELECT seed, routes, first_at, coalesce(reach, 0) AS reach FROM handlers LEFT JOIN reach USING (seed)),
best AS (SELECT routes AS r, reach AS w FROM c ORDER BY routes DESC, reach DESC, seed LIMIT 1),
chosen AS (SELECT seed AS trunk FROM c, best WHERE routes = r AND reach * 10 >= w * 9 ORDER BY first_at LIMIT 1)
SELECT seed, routes, reach, CAST(place AS INTEGER) AS place FROM (SELECT c.*, row_number() OVER (ORDER BY seed <> trunk, routes DESC, reach DESC, seed) - 1 AS place FROM c, chosen) WHERE place <= 60""")
def trunk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trunk (place 0) and the next 60 handlers: most routes, then widest reach; of near ties the one registered first."""
    edges = calls(spark, sf_dir)
    handlers = edges.where("kind = 'view'").groupBy(F.col("source").alias("seed")).agg(F.count(F.lit(1)).alias("routes"), F.min("id").alias("first_at"))
    found = handlers.join(reach_sizes(edges), "seed", "left").fillna(0, ["reach"])
    best = found.orderBy(F.desc("routes"), F.desc("reach"), "seed").limit(1).select(F.col("routes").alias("r"), F.col("reach").alias("w"))
    near = found.join(F.broadcast(best), (F.col("routes") == F.col("r")) & (F.col("reach") * 10 >= F.col("w") * 9))
    trunk = near.orderBy("first_at").limit(1).select(F.col("seed").alias("trunk"))
    met = found.join(F.broadcast(trunk)).withColumn("other", F.col("seed") != F.col("trunk"))
    ranked = aggregates.top(met, [F.asc("other"), F.desc("routes"), F.desc("reach"), F.asc("seed")], 61)
    return ranked.select("seed", "routes", "reach", (F.col("place") - 1).alias("place"))


def routes_sql(depth: int, fan: int, limit: int) -> str:
    """CTE placed_ (seed, place, route) of depth-first routes over follow_ (source, target, rank)."""
    out = ["p0 AS (SELECT DISTINCT source AS seed, source AS node, [source] AS route, CAST([] AS INTEGER[]) AS ranks FROM follow_)"]
    ends = []
    for k in range(depth):
        out.append(f"""q{k} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY ranks) AS pl FROM (
  SELECT p.seed, f.target AS node, list_append(p.route, f.target) AS route, list_append(p.ranks, f.rank) AS ranks, list_contains(p.route, f.target) AS again
  FROM p{k} p JOIN follow_ f ON p.node = f.source)) WHERE pl <= {limit})""")
        out.append(f"p{k + 1} AS (SELECT seed, node, route, ranks FROM q{k} WHERE NOT again)")
        ends.append(f"SELECT seed, route, ranks FROM q{k} WHERE again UNION ALL SELECT seed, route, ranks FROM p{k} WHERE node NOT IN (SELECT source FROM follow_)")
    ends.append(f"SELECT seed, route, ranks FROM p{depth}")
    out.append(f"placed_ AS (SELECT * FROM (SELECT seed, route, row_number() OVER (PARTITION BY seed ORDER BY ranks) AS place FROM ({' UNION ALL '.join(ends)})) WHERE place <= {limit})")
    return ", ".join(out)


@query(f"""{WITH_C}, pairs AS (SELECT source, target, min(id) AS id FROM calls WHERE target IS NOT NULL AND source <> target GROUP BY source, target),
follow_ AS MATERIALIZED (SELECT source, target, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS rank FROM pairs) WHERE rank <= 6),
{routes_sql(6, 6, 64)}
SELECT seed, CAST(place AS INTEGER) AS place, list_aggregate(list_transform(route, lambda x: CAST(x AS VARCHAR)), 'string_agg', '>') AS route FROM placed_""")
def routes_dfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes in depth-first order from every user: six steps of six, no cycles, 64 for each."""
    pairs = calls(spark, sf_dir).where("target is not null and source <> target").groupBy("source", "target").agg(F.min("id").alias("id"))
    found, _ = traversal.routes(pairs, sources(pairs))
    return found.select("seed", "place", F.array_join(F.transform("route", lambda x: x.cast("string")), ">").alias("route"))
