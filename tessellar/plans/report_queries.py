"""Caps, totals, orders and merges that reports are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import aggregates, diff, forest, traversal
from ..storage import keep
from .registry import query
from .views import LINKS_SQL, NODES_SQL, SNAPSHOTS_SQL, USES_SQL, links, nodes, package_keys, snapshots, table, use_keys


@query("""SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each context by time and id."""
    last = F.max(F.struct("ts", "event_id")).alias("m")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(last).select("event_type", "m.event_id")


@query("SELECT d.doc_id, b.first_doc FROM documents d JOIN (SELECT sha256(text) AS h, min(doc_id) AS first_doc FROM documents GROUP BY 1) b ON sha256(d.text) = b.h")
def content_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content addressed by hash: every document with the first holder of its content. Only hashes travel."""
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    blobs = hashed.groupBy("hash").agg(F.min("doc_id").alias("first_doc"))
    return hashed.join(blobs, "hash").select("doc_id", "first_doc")


@query(f"""WITH {LINKS_SQL}, first AS (SELECT host, href, min(page_id) AS page FROM links GROUP BY host, href)
SELECT host, href, page, CAST(place AS INTEGER) AS place FROM (
  SELECT host, href, page, row_number() OVER (PARTITION BY host ORDER BY starts_with(href, '/status'), page, href) AS place FROM first) WHERE place <= 20""")
def route_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of a host once each, as first seen, internal ones last; twenty of them."""
    first = links(spark, sf_dir).groupBy("host", "href").agg(F.min("page_id").alias("page"))
    order = Window.partitionBy("host").orderBy(F.col("href").startswith("/status"), "page", "href")
    return first.withColumn("place", F.row_number().over(order)).where("place <= 20")


@query("""SELECT event_id, user_id, CAST(row_number() OVER (ORDER BY value DESC, ts, event_id) AS INTEGER) AS place FROM events WHERE event_type = 'error' ORDER BY value DESC, ts, event_id LIMIT 100""")
def error_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", "value", "ts")
    return aggregates.top(errors, [F.desc("value"), F.asc("ts"), F.asc("event_id")], 100).drop("value", "ts")


@query("""SELECT s_suppkey AS supplier, s_acctbal < 0 AS held, n, CAST(row_number() OVER (ORDER BY s_acctbal < 0 DESC, n DESC, s_suppkey) AS INTEGER) AS place
FROM supplier JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey ORDER BY held DESC, n DESC, s_suppkey LIMIT 100""")
def shared_state_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held state first, then by how often it is touched."""
    touched = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count(F.lit(1)).alias("n"))
    held = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), (F.col("s_acctbal") < 0).alias("held"))
    return aggregates.top(held.join(touched, "supplier"), [F.desc("held"), F.desc("n"), F.asc("supplier")], 100)


@query("""SELECT user_id, event_id, event_type FROM (
  SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type""")
def adjacent_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of neighbouring equal entries the first."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    seen = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts").withColumn("before", before)
    return seen.where(~F.col("before").eqNullSafe(F.col("event_type"))).select("user_id", "event_id", "event_type")


@query("""SELECT user_id, event_id, CAST(place AS INTEGER) AS place FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events WHERE event_type = 'view') WHERE place <= 5""")
def reading_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = table(spark, sf_dir, "events").where("event_type = 'view'").select("user_id", "event_id", "value")
    ranked = views.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")))
    return ranked.where("place <= 5").select("user_id", "event_id", "place")


@query(f"""WITH {SNAPSHOTS_SQL}, x AS (SELECT DISTINCT supplier, part FROM b), y AS (SELECT DISTINCT supplier, part FROM h),
items AS (SELECT 0 AS ordinal, 'interface' AS kind, supplier, count(*) AS n FROM (SELECT * FROM x EXCEPT SELECT * FROM y) GROUP BY supplier
  UNION ALL SELECT 1, 'boundary', supplier, count(*) FROM (SELECT * FROM y EXCEPT SELECT * FROM x) GROUP BY supplier
  UNION ALL SELECT 2, 'artifact', supplier, count(*) FROM x GROUP BY supplier)
SELECT ordinal, kind, supplier, n, CAST(row_number() OVER (ORDER BY ordinal, supplier) AS INTEGER) AS place FROM items ORDER BY ordinal, supplier LIMIT 100""")
def checklist_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of several sources in the order of the sources, a hundred in all."""
    before, after = snapshots(spark, sf_dir)
    met = diff.tagged(before, after, ["supplier", "part"], ["supplier", "part"]).groupBy("supplier", "part").agg(F.max("sign").alias("most"), F.min("sign").alias("least"))
    kinds = (("interface", F.col("least") == 1), ("boundary", F.col("most") == -1), ("artifact", F.col("most") == 1))
    sums = met.groupBy("supplier").agg(*[F.count_if(held).alias(kind) for kind, held in kinds])
    item = F.array(*[F.struct(F.lit(k).alias("ordinal"), F.lit(kind).alias("kind"), F.col(kind).alias("n")) for k, (kind, _) in enumerate(kinds)])
    items = sums.select("supplier", F.explode(item).alias("i")).select("i.ordinal", "i.kind", "supplier", "i.n").where("n > 0")
    return aggregates.top(items, [F.asc("ordinal"), F.asc("supplier")], 100)


@query(f"""WITH {NODES_SQL}, {USES_SQL} SELECT s.package AS source, t.package AS target, u.kind, min(u.id) AS evidence, count(DISTINCT u.source) AS callers
FROM uses u JOIN nodes s ON u.source = s.id JOIN nodes t ON u.target = t.id GROUP BY ALL""")
def package_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations once for each pair and kind, with their first evidence."""
    packages, out = package_keys(spark, sf_dir), None
    for kind, to, keys in use_keys(spark, sf_dir):
        met = aggregates.located_edges(keys, packages["order"], targets=packages[to])
        callers = met.select("source_package", "target_package", "source").distinct().groupBy("source_package", "target_package").agg(F.count(F.lit(1)).alias("callers"))
        name = F.concat(F.lit("order:"), F.col("source").cast("string"), F.lit(f">{to}:"), F.col("target").cast("string"))
        first = met.groupBy("source_package", "target_package").agg(F.min(name).alias("evidence"))
        part = first.join(callers, ["source_package", "target_package"]).select(F.col("source_package").alias("source"), F.col("target_package").alias("target"), F.lit(kind).alias("kind"), "evidence", "callers")
        out = part if out is None else out.unionByName(part)
    return out


@query("""WITH m AS (SELECT conv_id, max(turn) AS t FROM conversations GROUP BY conv_id), s AS (
  SELECT c.conv_id, sha256(c.text) AS marked, sha256(l.text) AS now FROM conversations c JOIN m USING (conv_id) JOIN conversations l ON l.conv_id = m.conv_id AND l.turn = m.t WHERE c.turn = 0 OR c.turn = 1)
SELECT conv_id, count(*) AS marks, count(*) FILTER (marked <> now) AS needs_review FROM s GROUP BY conv_id""")
def mark_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks made at the first turns; one needs review when the conversation now ends otherwise."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("hash"))
    last = said.groupBy("conv_id").agg(F.max("turn").alias("turn")).join(said, ["conv_id", "turn"]).select("conv_id", F.col("hash").alias("now"))
    marked = said.where("turn in (0, 1)").join(last, "conv_id")
    return marked.groupBy("conv_id").agg(F.count(F.lit(1)).alias("marks"), F.count_if(F.col("hash") != F.col("now")).alias("needs_review"))


@query(f"""WITH RECURSIVE {NODES_SQL}, scope AS (SELECT id FROM nodes WHERE kind <> 'part' AND (contains(package, 'NATION_1') OR contains(path, 'NATION_1') OR id = 'region:0')),
up AS (SELECT s.id FROM scope s UNION SELECT n.parent FROM up JOIN nodes n ON n.id = up.id WHERE n.parent IS NOT NULL)
SELECT n.kind, count(*) AS n FROM up JOIN nodes n ON n.id = up.id GROUP BY n.kind""")
def scope_with_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes in a scope and all that contain them, by kind."""
    g = nodes(spark, sf_dir)
    scope = g.where((F.col("kind") != "part") & (F.col("package").contains("NATION_1") | F.col("path").contains("NATION_1") | (F.col("id") == "region:0")))
    tree = keep(forest.labels(g), "forest")
    above = forest.enclosing(tree.join(scope.select("id"), "id", "left_semi"), tree).select(F.col("a_id").alias("id"))
    ids = scope.select("id").unionByName(above).distinct()
    return g.join(ids, "id", "left_semi").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {NODES_SQL}, own AS (SELECT id, parent, CASE WHEN kind = 'order' AND name LIKE '1%' OR kind = 'customer' AND name LIKE '%3' OR kind IN ('nation', 'region') AND name LIKE '%1%' THEN name END AS v FROM nodes WHERE kind <> 'part'),
up(id, base, v, hops) AS (SELECT id, parent, v, 0 FROM own UNION ALL SELECT u.id, o.parent, o.v, u.hops + 1 FROM up u JOIN own o ON u.base = o.id WHERE u.v IS NULL AND u.hops < 6)
SELECT o.id, max(u.v) AS value, min(u.hops) FILTER (u.v IS NOT NULL) AS distance FROM own o JOIN up u USING (id) GROUP BY o.id""")
def inherited_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value that a node has itself or takes from the nearest ancestor that has one, six steps away at most."""
    own, name = nodes(spark, sf_dir).where("kind <> 'part'"), F.col("name")
    has = ((F.col("kind") == "order") & name.startswith("1")) | ((F.col("kind") == "customer") & name.endswith("3")) | (F.col("kind").isin("nation", "region") & name.contains("1"))
    return traversal.first_above(own.select("id"), own.where("parent is not null").select("id", "parent"), own.select("id", F.when(has, name).alias("value")), 6)


@query("""SELECT l_returnflag AS dimension, order_key, part, total, CASE WHEN total > 100 THEN 100 END AS next_offset FROM (
  SELECT l_returnflag, l_orderkey AS order_key, l_partkey AS part, count(*) OVER (PARTITION BY l_returnflag) AS total,
         row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) AS r FROM lineitem WHERE l_quantity >= 49) WHERE r <= 100""")
def dimension_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a dimension in order: a hundred, the total, and where the next page begins."""
    items = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_returnflag").alias("dimension"), F.col("l_orderkey").alias("order_key"), F.col("l_partkey").alias("part"), "l_suppkey", "l_linenumber")
    order = [F.asc(c) for c in ("order_key", "part", "l_suppkey", "l_linenumber")]
    first = aggregates.first_of_each(items, ["dimension"], order, 100)
    return first.select("dimension", "order_key", "part", "total", F.when(F.col("truncated"), 100).alias("next_offset"))


@query("""WITH now AS (SELECT conv_id, turn, sha256(text) AS h FROM conversations), cache AS (SELECT conv_id, turn, h FROM now WHERE turn <= 2)
SELECT n.conv_id, count(*) AS parsed, (SELECT count(*) FROM cache) AS cached FROM now n WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.conv_id = n.conv_id AND c.turn = n.turn AND c.h = n.h) GROUP BY n.conv_id""")
def incremental_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache of the first turns leaves to parse."""
    now = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("h"))
    cache = now.where("turn <= 2")
    left = now.join(cache, ["conv_id", "turn", "h"], "left_anti").groupBy("conv_id").agg(F.count(F.lit(1)).alias("parsed"))
    return left.join(F.broadcast(cache.agg(F.count(F.lit(1)).alias("cached"))))


@query("""SELECT role, count(*) AS n, CAST(max(turn) AS BIGINT) AS last_turn, count(DISTINCT c.conv_id) AS conversations, count(*) FILTER (l.doc_id IS NULL) AS invalid
FROM conversations c LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON c.conv_id = l.doc_id GROUP BY role""")
def knowledge_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by role, and those whose evidence (the label of their id) is not there."""
    there = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"), F.lit(True).alias("there")).distinct()
    said = table(spark, sf_dir, "conversations").join(there, "conv_id", "left")
    return said.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last_turn"), F.count_distinct("conv_id").alias("conversations"), F.count_if(F.col("there").isNull()).alias("invalid"))
