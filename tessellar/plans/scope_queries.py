"""Scope filters, entries, pages and admissions over the entity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scope
from ..operators import aggregates, lookup
from .registry import query
from .views import CALLS_SQL, NODES_SQL, calls, nodes, table

WITH_N = f"WITH {NODES_SQL.strip()}"


@query(f"""{WITH_N}, hits AS (SELECT id, qualified, path FROM nodes WHERE kind IN ('customer', 'supplier') AND contains(qualified, 'NATION_1'))
SELECT id, qualified, (SELECT count(*) FROM hits) AS total, (SELECT count(*) FROM hits) > 150 AS truncated, CASE WHEN (SELECT count(*) FROM hits) > 150 THEN 150 END AS next_cursor
FROM hits ORDER BY qualified, id LIMIT 100 OFFSET 50""")
def map_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the modules whose qualified name holds the query: 100 after 50, with the total and the next place."""
    found = nodes(spark, sf_dir).where("kind in ('customer', 'supplier')").where(F.col("qualified").contains("NATION_1")).select("id", "qualified")
    paged = lookup.page(found, [F.asc("qualified"), F.asc("id")], 50, 100)
    return paged.withColumn("next_cursor", F.when(F.col("truncated"), 150))


@query(f"""{WITH_N}, inside AS (SELECT DISTINCT package FROM nodes WHERE kind = 'nation' AND (contains(name, 'NATION_2') OR contains(path, 'NATION_2') OR id = 'NATION_2')),
ids AS (SELECT id, package FROM nodes WHERE contains(qualified, 'NATION_2') OR contains(path, 'NATION_2') OR id = 'NATION_2' OR package IN (SELECT package FROM inside))
SELECT package, count(*) AS total, count(*) > 100 AS truncated, min(id) AS first_id, max(id) AS last_id FROM ids GROUP BY package""")
def scope_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a change batch cut to a scope: members whose package, name, path or id is in it."""
    g = nodes(spark, sf_dir)
    q = "NATION_2"
    inside = g.where("kind = 'nation'").where(scope.package_in_scope(F.col("name"), F.col("path"), F.col("id"), q)).select("package").distinct().withColumn("inside", F.lit(True))
    met = g.select("id", "package", "qualified", "path").join(F.broadcast(inside), "package", "left")  # nations: a table of fixed size
    kept = met.where(F.col("qualified").contains(q) | F.col("path").contains(q) | (F.col("id") == q) | F.col("inside"))
    return kept.groupBy("package").agg(F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) > 100).alias("truncated"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(f"""{WITH_N} SELECT id, package FROM nodes WHERE kind <> 'order' AND (package = 'NATION_7' OR starts_with(path, 'AFRICA/NATION_') AND kind = 'supplier' OR starts_with(qualified, replace('Brand#1-', '-', '/')))""")
def scope_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a resolver: a package by name, a path or qualified name by its beginning; tests are left out."""
    name = F.col("qualified").startswith("Brand#1-".replace("-", "/"))
    return nodes(spark, sf_dir).where("kind <> 'order'").where((F.col("package") == "NATION_7") | (F.col("path").startswith("AFRICA/NATION_") & (F.col("kind") == "supplier")) | name).select("id", "package")


@query("""SELECT p_partkey AS part, p_name AS name FROM part WHERE contains(p_partkey || '|' || p_name || '|' || p_brand, 'Brand#2') OR p_partkey % 7 = 3 AND p_size IN (10, 20, 30)""")
def item_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose JSON holds the query, or whose nodes meet those of the scope."""
    part = table(spark, sf_dir, "part")
    item = F.struct("p_partkey", "p_name", "p_brand")
    own = F.array(F.when(F.col("p_partkey") % 7 == 3, F.col("p_size")))
    return part.where(scope.item_in_scope(item, own, "Brand#2", F.array(*map(F.lit, (10, 20, 30))))).select(F.col("p_partkey").alias("part"), F.col("p_name").alias("name"))


ENTRY_SQL = """units AS (SELECT c_custkey AS unit, CASE c_mktsegment WHEN 'BUILDING' THEN 'bin' WHEN 'MACHINERY' THEN 'example' WHEN 'FURNITURE' THEN 'build' WHEN 'HOUSEHOLD' THEN 'lib' ELSE 'test' END AS kind FROM customer),
mains AS (SELECT o_orderkey AS node, unit, kind FROM orders JOIN units ON o_custkey = unit WHERE o_orderpriority = '1-URGENT')"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as build units, by their market segment."""
    kind = F.col("c_mktsegment")
    kind = F.when(kind == "BUILDING", "bin").when(kind == "MACHINERY", "example").when(kind == "FURNITURE", "build").when(kind == "HOUSEHOLD", "lib").otherwise("test")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"), kind.alias("kind"))


def mains(spark: SparkSession, sf_dir: str, kinds: list[str]) -> DataFrame:
    """Urgent orders as main functions of the units of some kinds."""
    found = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("unit"))
    return found.join(units(spark, sf_dir).where(F.col("kind").isin(kinds)), "unit").select("node", "unit", "kind")


@query(f"WITH {ENTRY_SQL} SELECT node, unit, kind FROM mains WHERE kind IN ('bin', 'example', 'build')")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mains(spark, sf_dir, ["bin", "example", "build"])


@query(f"WITH {ENTRY_SQL} SELECT node, unit FROM mains WHERE kind = 'bin'")
def baseline_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mains(spark, sf_dir, ["bin"]).select("node", "unit")


@query(f"""WITH {ENTRY_SQL} SELECT 'program' AS tier, CAST(node AS VARCHAR) AS entry FROM mains WHERE kind = 'bin'
UNION ALL SELECT 'behaviour', o_clerk FROM (SELECT DISTINCT event_type AS o_clerk FROM events) UNION ALL SELECT 'library', CAST(unit AS VARCHAR) FROM units WHERE kind = 'lib'""")
def browser_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs, behaviours and libraries, each tier from its own source."""
    program = mains(spark, sf_dir, ["bin"]).select(F.lit("program").alias("tier"), F.col("node").cast("string").alias("entry"))
    behaviour = table(spark, sf_dir, "events").select(F.lit("behaviour").alias("tier"), F.col("event_type").alias("entry")).distinct()
    library = units(spark, sf_dir).where("kind = 'lib'").select(F.lit("library").alias("tier"), F.col("unit").cast("string").alias("entry"))
    return program.unionByName(behaviour).unionByName(library)


@query(f"""WITH {ENTRY_SQL}, starts AS (SELECT 0 AS tier, 'program' AS kind, CAST(node AS VARCHAR) AS name FROM mains WHERE kind = 'bin'
UNION ALL SELECT 1, 'library', CAST(unit AS VARCHAR) FROM units WHERE kind = 'lib' UNION ALL SELECT 2, 'source', CAST(p_partkey AS VARCHAR) FROM part)
SELECT kind, name, CAST(row_number() OVER (ORDER BY name) AS INTEGER) AS place FROM starts WHERE tier = (SELECT min(tier) FROM starts) ORDER BY name LIMIT 4""")
def start_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four starts of the first tier that has any: programs, else libraries, else declarations."""
    tier = lambda df, k, kind, name: df.select(F.lit(k).alias("tier"), F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"))
    starts = tier(mains(spark, sf_dir, ["bin"]), 0, "program", "node").unionByName(tier(units(spark, sf_dir).where("kind = 'lib'"), 1, "library", "unit"))
    starts = starts.unionByName(tier(table(spark, sf_dir, "part"), 2, "source", "p_partkey"))
    first = starts.agg(F.min("tier").alias("first"))
    found = starts.join(F.broadcast(first), F.col("tier") == F.col("first")).select("kind", "name")
    return aggregates.top(found, [F.asc("name")], 4)


SPELLING_SQL = """CASE event_type WHEN 'error' THEN 'std::fs::read' WHEN 'signup' THEN 'os.getenv' WHEN 'view' THEN 'subprocess.run' WHEN 'click' THEN 'open' ELSE 'os.path.join' END"""


@query(f"""SELECT user_id, spelling, count(*) AS calls FROM (SELECT user_id, {SPELLING_SQL} AS spelling FROM events)
WHERE regexp_matches(spelling, '^(std::env::|std::fs::|os\\.getenv|os\\.environ|subprocess\\.|std::process::)') OR spelling = 'open' GROUP BY ALL""")
def runtime_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose spelling suggests that they leave the program, by user."""
    kind = F.col("event_type")
    spelling = F.when(kind == "error", "std::fs::read").when(kind == "signup", "os.getenv").when(kind == "view", "subprocess.run").when(kind == "click", "open").otherwise("os.path.join")
    found = table(spark, sf_dir, "events").select("user_id", spelling.alias("spelling"))
    return found.where(scope.runtime_boundary(F.col("spelling"))).groupBy("user_id", "spelling").agg(F.count(F.lit(1)).alias("calls"))


@query("""WITH s AS (SELECT p_partkey AS node, p_brand AS unit, CASE p_type WHEN 'PROMO' THEN 'pub(crate)' WHEN 'ECONOMY' THEN 'public' ELSE 'private' END AS visibility,
  CASE WHEN p_size < 10 THEN 'trait' WHEN p_size < 25 THEN 'type' ELSE 'function' END AS kind FROM part),
first AS (SELECT * FROM s WHERE visibility LIKE 'pub%' ORDER BY CASE kind WHEN 'trait' THEN 0 WHEN 'type' THEN 1 ELSE 2 END, node LIMIT 64)
SELECT node, unit, kind FROM first WHERE unit <> 'Brand#3'""")
def public_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 64 public declarations by kind, and of these the ones in production units."""
    kind, size = F.col("p_type"), F.col("p_size")
    visibility = F.when(kind == "PROMO", "pub(crate)").when(kind == "ECONOMY", "public").otherwise("private")
    rank = F.when(size < 10, 0).when(size < 25, 1).otherwise(2)
    found = table(spark, sf_dir, "part").where(visibility.startswith("pub")).select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("unit"), rank.alias("rank"))
    first = found.orderBy("rank", "node").limit(64).where("unit <> 'Brand#3'")
    return first.select("node", "unit", F.element_at(F.array(*map(F.lit, ("trait", "type", "function"))), F.col("rank") + 1).alias("kind"))


MATERIAL_SQL = """SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) || CASE page_id % 7 WHEN 0 THEN '/mod.rs' WHEN 1 THEN '/.env/a.py' WHEN 2 THEN '/vendor/x.rs' WHEN 3 THEN '/README.md'
  WHEN 4 THEN '/Cargo.toml' WHEN 5 THEN '/notes.txt' ELSE '/app.pyi' END AS path FROM pages"""


@query(f"""SELECT page_id, path FROM ({MATERIAL_SQL}) WHERE NOT regexp_matches(path, '(^|/)(\\.|(runtime-data|vendor|target)(/|$))')
AND (regexp_matches(path, '\\.(rs|py|pyi)$') OR regexp_matches(path, '(^|/)(Cargo\\.toml|pyproject\\.toml)$') OR regexp_matches(lower(path), '(^|/)readme(\\.md|\\.rst|\\.markdown)?$'))""")
def explanation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files under the pages' paths that an explanation may quote."""
    names = ["/mod.rs", "/.env/a.py", "/vendor/x.rs", "/README.md", "/Cargo.toml", "/notes.txt", "/app.pyi"]
    ending = F.element_at(F.array(*map(F.lit, names)), (F.col("page_id") % 7 + 1).cast("int"))
    path = F.concat(F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1), ending)
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).where(scope.explanation_material(F.col("path")))


@query(f"""{WITH_N}, focus AS (SELECT min(path) AS p, min(qualified) AS title FROM nodes WHERE kind = 'nation')
SELECT id, path FROM nodes, focus WHERE kind <> 'order' AND (qualified = title OR path = p OR starts_with(path, p || '/') OR starts_with(p, path || '/'))""")
def focus_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What belongs to the focus, the first nation: its own title, and paths above and below its path."""
    g = nodes(spark, sf_dir)
    focus = g.where("kind = 'nation'").agg(F.min("path").alias("p"), F.min("qualified").alias("title"))
    met = g.where("kind <> 'order'").join(F.broadcast(focus))
    return met.where((F.col("qualified") == F.col("title")) | scope.paths_related(F.col("path"), F.col("p"))).select("id", "path")


@query("""SELECT conv_id, bool_or(length(text) > 400) OR count(*) > 6 OR bool_or(turn >= 9) AS truncated FROM conversations GROUP BY conv_id""")
def truncated_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report is cut when any of its parts is."""
    parts = F.bool_or(F.length("text") > 400) | (F.count(F.lit(1)) > 6) | F.bool_or(F.col("turn") >= 9)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(parts.alias("truncated"))


@query("""SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) >= 50 THEN 'k=' || CAST(json_extract(props, '$.k') AS VARCHAR) ELSE '' END AS attributes FROM events WHERE event_type <> 'error'""")
def column_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests dropped, and of the attributes only the named ones with a value that counts, by name."""
    kept = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: k.isin("k", "derive", "route") & (v.cast("long") >= 50))
    pairs = F.transform(F.array_sort(F.map_keys(kept)), lambda k: F.concat(k, F.lit("="), F.element_at(kept, k)))
    return table(spark, sf_dir, "events").where("event_type <> 'error'").select("event_id", F.array_join(pairs, ",").alias("attributes"))


@query(f"""{WITH_N}, hits AS (SELECT id, kind, package, path FROM nodes WHERE package LIKE 'NATION_1%' AND kind = 'supplier')
SELECT id, package, (SELECT count(*) FROM hits) AS total, (SELECT count(*) FROM hits) > 100 AS truncated FROM hits ORDER BY path, id LIMIT 100""")
def symbol_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of 100 symbols under the filters that are given: package and kind here, no path."""
    return lookup.symbols(nodes(spark, sf_dir), package="NATION_1", kind="supplier").select("id", "package", "total", "truncated")


@query(f"""WITH {CALLS_SQL}, hits AS (SELECT id, source, target, resolution FROM calls WHERE resolution <> 'external' AND source = (SELECT min(source) FROM calls))
SELECT id, source, target, resolution, (SELECT count(*) FROM hits) AS total, (SELECT count(*) FROM hits) > 100 AS truncated FROM hits ORDER BY id LIMIT 100""")
def relation_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of the relations that leave one node, but for external ones."""
    edges = calls(spark, sf_dir)
    first = edges.agg(F.min("source").alias("source"))
    found = edges.join(F.broadcast(first), "source").where("resolution <> 'external'").select("id", "source", "target", "resolution")
    return lookup.page(found, [F.asc("id")], 0, 100)


@query("""SELECT o_custkey AS customer, count(*) AS definitions FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey""")
def definitions_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("customer")).agg(F.count(F.lit(1)).alias("definitions"))


@query("""SELECT conv_id, turn, CAST(row_number() OVER (ORDER BY length(text) DESC, conv_id, turn DESC) AS INTEGER) AS place FROM conversations ORDER BY length(text) DESC, conv_id, turn DESC LIMIT 100""")
def knowledge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by when they were updated (here their length), id and revision; the newest first."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("updated"))
    return aggregates.top(rows, [F.desc("updated"), F.asc("conv_id"), F.desc("turn")], 100).drop("updated")


@query(f"""WITH o AS (SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'user' ELSE 'made' END AS origin FROM lineitem),
kept AS (SELECT l_orderkey AS k, l_partkey AS item, 0 AS part FROM o WHERE origin <> 'user'), fresh AS (SELECT l_orderkey, l_partkey, 1 FROM (SELECT DISTINCT l_orderkey, l_partkey FROM o WHERE origin = 'user'))
SELECT k AS order_key, item, part, count(*) AS n FROM (SELECT * FROM kept UNION ALL SELECT * FROM fresh) GROUP BY ALL""")
def replace_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list with its user items dropped and fresh ones, each once, appended."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_partkey").alias("item"), (F.col("l_returnflag") == "R").alias("user"))
    kept = lines.where("not user").select("order_key", "item", F.lit(0).alias("part"))
    fresh = lines.where("user").select("order_key", "item").distinct().withColumn("part", F.lit(1))
    return kept.unionByName(fresh).groupBy("order_key", "item", "part").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT part, item, CAST(place AS INTEGER) AS place, total, total > 100 AS truncated FROM (
  SELECT *, row_number() OVER (ORDER BY part, item) AS place, count(*) OVER () AS total FROM (
    SELECT 0 AS part, s_suppkey AS item FROM supplier UNION ALL SELECT 1, p_partkey FROM part)) WHERE place <= 100""")
def prepend_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraint items before verification items, 100 of them, with the total of both."""
    both = table(spark, sf_dir, "supplier").select(F.lit(0).alias("part"), F.col("s_suppkey").alias("item"))
    both = both.unionByName(table(spark, sf_dir, "part").select(F.lit(1).alias("part"), F.col("p_partkey").alias("item")))
    total = both.agg(F.count(F.lit(1)).alias("total"))
    return aggregates.top(both, [F.asc("part"), F.asc("item")], 100).join(F.broadcast(total)).withColumn("truncated", F.col("total") > 100)
