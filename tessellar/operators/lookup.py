"""Symbol lookup, neighbours and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.predicates import holds, like_literal


def lookup_stage(query: str) -> Column:
    """1 exact id, 2 exact qualified name, 3 exact name, 4 part of the qualified name or start of the id; else null."""
    part = like_literal(query)
    loose = holds(F.col("qualified"), f"%{part}%") | holds(F.col("id"), f"{part}%")
    return F.when(F.col("id") == query, 1).when(F.col("qualified") == query, 2).when(F.col("name") == query, 3).when(loose, 4)


def find_nodes(nodes: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Nodes of the first stage that has any, by qualified name, path and id. One scan finds all stages; the least of
    them is a one-row aggregate."""
    staged = nodes.withColumn("stage", lookup_stage(query)).where("stage is not null")
    first = staged.agg(F.min("stage").alias("first_stage"))
    found = staged.join(F.broadcast(first), F.col("stage") == F.col("first_stage")).drop("first_stage")
    return found.orderBy("qualified", "path", "id").limit(limit) if limit else found


def neighbours(edges: DataFrame, ids: DataFrame, incoming: bool = False, kinds: list[str] | None = None) -> DataFrame:
    """Edges that enter or leave the nodes of ids (one column, id)."""
    side = "target" if incoming else "source"
    found = edges.join(ids.select(F.col("id").alias(side)), side, "left_semi")
    return found.where(F.col("kind").isin(kinds)) if kinds else found


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page in a total order, with the total and whether more follow. Spark keeps offset + limit rows a task."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    part = rows.orderBy(*order).offset(offset).limit(limit)
    return part.join(F.broadcast(total)).withColumn("truncated", F.col("total") > offset + limit)


def symbols(nodes: DataFrame, package: str | None = None, path: str | None = None, kind: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of nodes under the filters that are given: a package or path that begins so, a kind; by path and id."""
    found = nodes
    for column, start in (("package", package), ("path", path)):
        found = found.where(F.col(column).startswith(start)) if start else found
    found = found.where(F.col("kind") == kind) if kind else found
    return page(found, [F.asc("path"), F.asc("id")], offset, limit)


def inspect(nodes: DataFrame, edges: DataFrame, query: str, limit: int = 20, around: int = 50, source: DataFrame | None = None, marks: DataFrame | None = None, lines: int = 45, chars: int = 600) -> DataFrame:
    """section, place, id, other, kind, truncated: the candidates of a query, or its one node with up to ``around`` edges on
    each side, the first ``lines`` lines of its source (id, line, text) cut to ``chars`` characters, and its mark (id, state).
    Only the candidates, of which there are limit + 1 at most, are looked at before the rest is."""
    found = find_nodes(nodes, query, limit + 1).select("id", "qualified", "kind").collect()
    spark = nodes.sparkSession
    schema = "section string, place int, id string, other string, kind string, truncated boolean"
    if len(found) != 1:
        rows = [("candidate", k, r.id, r.qualified, r.kind, len(found) > limit) for k, r in enumerate(found[:limit], 1)]
        return spark.createDataFrame(rows, schema)
    node = found[0]
    out = spark.createDataFrame([("node", 1, node.id, node.qualified, node.kind, False)], schema)
    for section, near, far in (("outgoing", "source", "target"), ("incoming", "target", "source")):
        side = edges.where(F.col(near) == node.id).orderBy("id").limit(around + 1)
        placed = side.withColumn("place", F.row_number().over(Window.orderBy("id")))
        size = F.count(F.lit(1)).over(Window.partitionBy())
        part = placed.withColumn("truncated", size > around).where(F.col("place") <= around)
        out = out.unionByName(part.select(F.lit(section).alias("section"), "place", "id", F.col(far).alias("other"), "kind", "truncated"))
    if source is not None:
        own = source.where(F.col("id") == node.id)
        total = own.agg(F.max("line").alias("last"))
        part = own.where(F.col("line") <= lines).join(F.broadcast(total))
        out = out.unionByName(part.select(F.lit("snippet").alias("section"), F.col("line").cast("int").alias("place"), "id", F.substring("text", 1, chars).alias("other"), F.lit("line").alias("kind"), (F.col("last") > lines).alias("truncated")))
    if marks is not None:
        own = marks.where(F.col("id") == node.id)
        out = out.unionByName(own.select(F.lit("mark").alias("section"), F.lit(1).alias("place"), "id", F.col("state").alias("other"), F.lit("mark").alias("kind"), F.lit(False).alias("truncated")))
    return out


def holding(nodes: DataFrame, columns: list[str], part: str) -> DataFrame:
    """Nodes with a column that holds a text in any case of ASCII letters; one scan."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(holds(F.col(c), f"%{like_literal(part)}%"), F.lit(False))
    return nodes.where(found)


def search(nodes: DataFrame, part: str, exact: str, limit: int) -> DataFrame:
    """Nodes whose name, qualified name or path holds a text in any case, those of the exact name first; with their place."""
    like = f"%{like_literal(part)}%"
    hits = nodes.where(holds(F.col("name"), like) | holds(F.col("qualified"), like) | holds(F.col("path"), like))
    order = [F.when(F.col("name") == exact, 0).otherwise(1), F.asc("qualified"), F.asc("path"), F.asc("id")]
    return hits.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)))
