"""Traversals over the user graph and the containment forest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import condense, forest, traversal
from ..storage import keep
from .registry import query
from .views import FOLLOWS_SQL, NODES_SQL, USES_SQL, follows, nodes, uses

WALK = """walk(seed, id, depth) AS (
  SELECT {seed} AS seed, {seed} AS id, 0 AS depth {start}
  UNION
  SELECT w.seed, f.{far}, w.depth + 1 FROM walk w JOIN follows f ON w.id = f.{near} WHERE w.depth < {depth}
)"""


def least_user(edges: DataFrame) -> DataFrame:
    return edges.agg(F.min("source").alias("id"))


def walk_sql(near: str, far: str, depth: int) -> str:
    walk = WALK.format(seed="(SELECT min(source) FROM follows)", start="", near=near, far=far, depth=depth)
    return f"WITH RECURSIVE {FOLLOWS_SQL}, {walk} SELECT id, min(depth) AS depth FROM walk GROUP BY id"


@query(walk_sql("source", "target", 2))
def trace_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = follows(spark, sf_dir)
    return traversal.reach(edges, least_user(edges), 2).select("id", "depth")


@query(walk_sql("target", "source", 2))
def trace_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = follows(spark, sf_dir)
    return traversal.reach(edges.select(F.col("target").alias("source"), F.col("source").alias("target")), least_user(edges), 2).select("id", "depth")


@query(f"""WITH RECURSIVE {FOLLOWS_SQL}, r(id) AS (SELECT min(source) FROM follows UNION SELECT f.target FROM r JOIN follows f ON r.id = f.source)
SELECT count(*) AS reached FROM r""")
def reach_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = follows(spark, sf_dir)
    return traversal.reach(edges, least_user(edges)).agg(F.count(F.lit(1)).alias("reached"))


@query(f"""WITH {FOLLOWS_SQL}, t AS (SELECT min(target) AS id FROM follows), one AS (SELECT source, target FROM follows JOIN t ON target = t.id)
SELECT target, source AS caller, 1 AS hops, source AS via FROM one
UNION ALL SELECT o.target, f.source, 2, min(f.target) FROM one o JOIN follows f ON f.target = o.source
WHERE f.source <> o.target AND NOT EXISTS (SELECT 1 FROM one x WHERE x.source = f.source) GROUP BY o.target, f.source""")
def impact_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = follows(spark, sf_dir)
    return traversal.two_hops(edges, edges.agg(F.min("target").alias("id")))


@query(f"""WITH RECURSIVE {NODES_SQL}, up(id, ancestor, distance) AS (
  SELECT id, parent, 1 FROM nodes WHERE parent IS NOT NULL
  UNION ALL SELECT u.id, n.parent, u.distance + 1 FROM up u JOIN nodes n ON u.ancestor = n.id WHERE n.parent IS NOT NULL)
SELECT id, ancestor, distance FROM up""")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.ancestors(nodes(spark, sf_dir))


@query(f"""WITH {NODES_SQL}, {USES_SQL}, t AS (SELECT u.source, n.package FROM uses u JOIN nodes n ON u.target = n.id AND u.kind = 'uses_supplier')
SELECT package, count(DISTINCT source) AS tests, count(*) AS links FROM t GROUP BY package""")
def linked_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tests of the components that their suppliers belong to."""
    where = nodes(spark, sf_dir).select(F.col("id").alias("target"), "package")
    met = uses(spark, sf_dir).where("kind = 'uses_supplier'").join(where, "target")
    return met.groupBy("package").agg(F.count_distinct("source").alias("tests"), F.count(F.lit(1)).alias("links"))


@query(f"""WITH {FOLLOWS_SQL}, two AS (SELECT source, target FROM follows UNION SELECT a.source, b.target FROM follows a JOIN follows b ON a.target = b.source),
r AS (SELECT source AS id, least(count(*), 400) AS reach FROM two WHERE source <> target GROUP BY source), m AS (SELECT max(reach) AS top FROM r)
SELECT id, reach, top FROM r, m WHERE reach * 10 >= top * 9 ORDER BY id LIMIT 1""")
def trunk_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of all starts that reach at least nine tenths of the widest reach within two steps; reaches are cut at 400,
    so that a start never holds more."""
    reach = keep(condense.near_reach(follows(spark, sf_dir), 400, 2).where("reach > 0"), "reach")
    top = reach.agg(F.max("reach").alias("top"))
    return reach.join(F.broadcast(top), F.col("reach") * 10 >= F.col("top") * 9).orderBy("id").limit(1)
