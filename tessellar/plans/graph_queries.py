"""Lookup, neighbours, aggregates, ranks and rules over the entity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, lookup, rules
from .registry import query
from .views import LINKS_SQL, NODES_SQL, USES_SQL, links, nodes, package_keys, table, use_keys, uses

WITH_G = f"WITH {NODES_SQL.strip()}, {USES_SQL.strip()}"


def relations_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between packages, kind by kind on number keys."""
    packages = package_keys(spark, sf_dir)
    parts = [aggregates.component_relations(keys.withColumn("kind", F.lit(kind)), packages["order"], packages[to]) for kind, to, keys in use_keys(spark, sf_dir)]
    return parts[0].unionByName(parts[1])


@query(f"""{WITH_G}
SELECT s.package AS source_package, t.package AS target_package, u.kind, count(*) AS relations
FROM uses u JOIN nodes s ON u.source = s.id JOIN nodes t ON u.target = t.id WHERE s.package <> t.package GROUP BY ALL""")
def component_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations_of(spark, sf_dir)


@query(f"WITH {NODES_SQL} SELECT package, kind, count(*) AS n FROM nodes GROUP BY package, kind")
def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).groupBy("package", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {NODES_SQL} SELECT package, count(DISTINCT path) AS paths FROM nodes GROUP BY package")
def distinct_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).groupBy("package").agg(F.count_distinct("path").alias("paths"))


@query(f"""WITH {NODES_SQL}
SELECT package, count(*) AS n, CAST(sum(CASE WHEN kind = 'order' THEN 1 ELSE 0 END) AS BIGINT) AS orders,
       CAST(sum(CASE WHEN kind = 'customer' THEN 1 ELSE 0 END) AS BIGINT) AS customers, count(DISTINCT kind) AS kinds, min(path) AS first_path
FROM nodes GROUP BY package""")
def component_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.component_summary(nodes(spark, sf_dir))


@query(f"""{WITH_G}
SELECT package, dependents, row_number() OVER (ORDER BY dependents DESC, package) AS place FROM (
  SELECT t.package, count(DISTINCT s.package) AS dependents
  FROM uses u JOIN nodes s ON u.source = s.id JOIN nodes t ON u.target = t.id WHERE s.package <> t.package GROUP BY t.package)
ORDER BY dependents DESC, package LIMIT 32""")
def dependents_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = aggregates.top(aggregates.dependents(relations_of(spark, sf_dir)), [F.desc("dependents"), F.asc("package")], 32)
    return ranked.withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {NODES_SQL}, first AS (SELECT min(name) AS q FROM nodes WHERE kind = 'part'), staged AS (
  SELECT id, qualified, path, CASE WHEN id = q THEN 1 WHEN qualified = q THEN 2 WHEN name = q THEN 3
    WHEN qualified ILIKE '%' || q || '%' OR id ILIKE q || '%' THEN 4 END AS stage FROM nodes, first)
SELECT id, qualified, path, stage FROM staged WHERE stage = (SELECT min(stage) FROM staged)""")
def symbol_lookup_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_nodes = nodes(spark, sf_dir)
    wanted = all_nodes.where("kind = 'part'").agg(F.min("name")).first()[0] or ""
    return lookup.find_nodes(all_nodes, wanted).select("id", "qualified", "path", "stage")



HUBS_SQL = f"{WITH_G}, hubs AS (SELECT target AS id FROM uses WHERE kind = 'uses_supplier' GROUP BY target ORDER BY count(*) DESC, target LIMIT 20)"


def hubs(edges: DataFrame) -> DataFrame:
    most = edges.where("kind = 'uses_supplier'").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return most.orderBy(F.desc("n"), "id").limit(20).select("id")


@query(f"""{HUBS_SQL} SELECT id, source, target, CAST(place AS INTEGER) AS place, total, truncated FROM (
  SELECT u.id, u.source, u.target, row_number() OVER (PARTITION BY u.target ORDER BY u.id) AS place, count(*) OVER (PARTITION BY u.target) AS total,
         count(*) OVER (PARTITION BY u.target) > 50 AS truncated FROM uses u JOIN hubs h ON u.target = h.id) WHERE place <= 50""")
def neighbours_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = uses(spark, sf_dir)
    found = lookup.neighbours(edges, hubs(edges), incoming=True).select("id", "source", "target")
    return aggregates.first_of_each(found, ["target"], [F.asc("id")], 50)


@query(f"""{WITH_G}, big AS (SELECT source AS id FROM uses GROUP BY source ORDER BY count(*) DESC, source LIMIT 100)
SELECT u.source, u.target, u.kind FROM uses u JOIN big b ON u.source = b.id""")
def neighbours_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = uses(spark, sf_dir)
    big = edges.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(100)
    return lookup.neighbours(edges, big).select("source", "target", "kind")


@query("""WITH m AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS package, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS module FROM pages)
SELECT package, min(split_part(module, '/', 1)) AS namespace, count(*) AS modules FROM m WHERE module <> '' GROUP BY package HAVING count(DISTINCT split_part(module, '/', 1)) = 1 AND bool_or(contains(module, '/'))""")
def unique_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The namespace of packages whose modules (paths of a host's pages) all begin alike, where one at least has a segment more."""
    module = F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1).alias("module")
    modules = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("package"), module).where("module <> ''")
    first = F.split_part("module", F.lit("/"), F.lit(1))
    found = modules.groupBy("package").agg(F.min(first).alias("namespace"), F.count(F.lit(1)).alias("modules"), F.max(first).alias("last"), F.bool_or(F.col("module").contains("/")).alias("dotted"))
    return found.where("namespace = last and dotted").drop("last", "dotted")


RULES = [(0, "*/customer/*/order/*", "parts/Brand#1*"), (1, "ASIA/*", "*/supplier/?"), (2, "EUROPE/*", "EUROPE/*/supplier/*")]
RULES_SQL = "rules AS (SELECT * FROM (VALUES (0, '^.*/customer/.*/order/.*$', '^parts/Brand#1.*$'), (1, '^ASIA/.*$', '^.*/supplier/.$'), (2, '^EUROPE/.*$', '^EUROPE/.*/supplier/.*$')) v(position, f, t))"
VIOLATIONS_SQL = f"""{WITH_G}, {RULES_SQL}, broken AS (
  SELECT position, u.id, u.source, u.target, u.kind, s.path AS source_path, t.path AS target_path FROM uses u JOIN nodes s ON u.source = s.id JOIN nodes t ON u.target = t.id
  JOIN rules ON regexp_matches(s.path, f) AND regexp_matches(t.path, rules.t))"""


@query(f"{VIOLATIONS_SQL} SELECT position, source, target, kind FROM broken")
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.violations(uses(spark, sf_dir), nodes(spark, sf_dir), RULES).select("position", "source", "target", "kind")


@query(f"""{VIOLATIONS_SQL} SELECT position, source, target, CAST(place AS INTEGER) AS place, total, total > 100 AS truncated FROM (
  SELECT *, row_number() OVER (ORDER BY source_path, target_path, id, position) AS place, count(*) OVER () AS total FROM broken WHERE kind = 'uses_supplier') WHERE place <= 100""")
def rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 findings on relations of known target, by the paths of their ends, with the total."""
    known = uses(spark, sf_dir).withColumn("resolution", F.when(F.col("kind") == "uses_supplier", "static").otherwise("unresolved"))
    found = rules.violations(known.where(rules.known_target("resolution")), nodes(spark, sf_dir), RULES)
    return rules.first_findings(found, 100).select("position", "source", "target", "place", "total", "truncated")


@query(f"""WITH {NODES_SQL}, prefixes AS (SELECT path AS prefix FROM nodes WHERE kind IN ('region', 'nation', 'customer'))
SELECT n.path, arg_max(p.prefix, length(p.prefix)) AS prefix FROM (SELECT DISTINCT path FROM nodes) n
JOIN prefixes p ON n.path = p.prefix OR starts_with(n.path, p.prefix || '/') GROUP BY n.path""")
def owner_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = nodes(spark, sf_dir)
    return rules.owners(g.select("path").distinct(), g.where("kind in ('region', 'nation', 'customer')").select(F.col("path").alias("prefix")))


@query(f"""WITH {NODES_SQL} SELECT path FROM nodes WHERE (regexp_matches(path, '^parts/.*$') OR regexp_matches(path, '^.*/supplier/.*$')) AND NOT regexp_matches(path, '^parts/Brand#2.*$')""")
def glob_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.members(nodes(spark, sf_dir).select("path"), ["parts/*", "*/supplier/*"], ["parts/Brand#2*"])


@query(f"{WITH_G} SELECT n.id, n.package FROM nodes n WHERE n.kind = 'order' AND NOT EXISTS (SELECT 1 FROM uses u WHERE u.source = n.id)")
def no_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that nothing leads to, seen from the parts: the relations are turned round."""
    turned = uses(spark, sf_dir).select(F.col("source").alias("id"))
    return nodes(spark, sf_dir).where("kind = 'order'").select("id", "package").join(turned, "id", "left_anti")


@query("""SELECT p_name AS name, min(p_partkey) AS part FROM part GROUP BY p_name HAVING count(*) = 1
UNION ALL SELECT p_brand || '/' || p_name, min(p_partkey) FROM part GROUP BY p_brand, p_name HAVING count(*) = 1""")
def unique_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name binds only where exactly one definition has it."""
    part = table(spark, sf_dir, "part").select("p_name", "p_brand", "p_partkey")
    once = lambda name: part.groupBy(name.alias("name")).agg(F.min("p_partkey").alias("part"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return once(F.col("p_name")).unionByName(once(F.concat_ws("/", "p_brand", "p_name")))


@query(f"""WITH {LINKS_SQL}, hosts AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages)
SELECT l.page_id, l.href, h.host AS target_host FROM links l LEFT JOIN hosts h ON regexp_extract(l.href, '^[a-z]+://([^/]+)', 1) = h.host""")
def unresolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link with its target host among the captured ones; null where the target is unknown."""
    hosts = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("target_host")).distinct()
    found = links(spark, sf_dir).withColumn("wanted", F.regexp_extract("href", "^[a-z]+://([^/]+)", 1))
    return found.join(hosts, F.col("wanted") == F.col("target_host"), "left").select("page_id", "href", "target_host")


@query(f"""WITH {LINKS_SQL} SELECT host, CASE WHEN regexp_matches(href, '^[a-z]+://') THEN 'absolute' WHEN starts_with(href, '/') THEN 'route' ELSE 'other' END AS form,
count(*) AS n, count(DISTINCT href) AS targets FROM links GROUP BY 1, 2""")
def link_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.when(F.col("href").rlike("^[a-z]+://"), "absolute").when(F.col("href").startswith("/"), "route").otherwise("other")
    return links(spark, sf_dir).groupBy("host", form.alias("form")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("href").alias("targets"))


@query("""SELECT split_part(regexp_replace(url, '^[a-z]+://[^/]+/', ''), '/', 1) AS prefix, count(*) AS n FROM pages GROUP BY 1""")
def method_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.split_part(F.regexp_replace("url", "^[a-z]+://[^/]+/", ""), F.lit("/"), F.lit(1))
    return table(spark, sf_dir, "pages").groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


CATEGORIES = {"STEEL": "metal", "COPPER": "metal", "BRASS": "alloy", "TIN": "metal", "NICKEL": "metal"}


@query("""SELECT p_brand AS package, coalesce(CASE WHEN p_type ILIKE '%steel%' OR p_type ILIKE '%copper%' OR p_type ILIKE '%tin%' OR p_type ILIKE '%nickel%' THEN 'metal'
WHEN p_type ILIKE '%brass%' THEN 'alloy' END, 'other') AS category, count(*) AS n FROM part GROUP BY ALL""")
def external_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the category that the last word of their type maps to."""
    kind = F.upper("p_type")
    category = F.lit(None).cast("string")
    for group in ("alloy", "metal"):
        for word in [w for w, g in CATEGORIES.items() if g == group]:
            category = F.when(kind.contains(word), group).otherwise(category)
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("package"), F.coalesce(category, F.lit("other")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT order_key, supplier, CAST(place AS INTEGER) AS place FROM (
  SELECT order_key, supplier, row_number() OVER (PARTITION BY order_key ORDER BY first_at, supplier) AS place FROM (
    SELECT l_orderkey AS order_key, l_suppkey AS supplier, min({'a': l_linenumber, 'b': l_partkey}) AS first_at FROM lineitem GROUP BY ALL)) WHERE place <= 3""")
def distinct_evidence_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_suppkey").alias("supplier"), "l_linenumber", "l_partkey")
    return aggregates.distinct_in_order(lines, ["order_key"], ["supplier"], ["l_linenumber", "l_partkey"], 3)


@query("""SELECT customer, order_key, total, CAST(place AS INTEGER) AS place, total > 5 AS truncated FROM (
  SELECT o_custkey AS customer, o_orderkey AS order_key, count(*) OVER (PARTITION BY o_custkey) AS total,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders) WHERE place <= 5""")
def cap_and_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order_key"))
    return aggregates.first_of_each(orders, ["customer"], [F.asc("order_key")], 5)


@query("""SELECT l_orderkey AS order_key, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS members, count(*) AS n FROM lineitem GROUP BY l_orderkey""")
def members_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents with the ordered list of their members; a list is bounded by what one order can hold."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    held = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    out = lines.groupBy(F.col("l_orderkey").alias("order_key")).agg(held.alias("m"), F.count(F.lit(1)).alias("n"))
    return out.select("order_key", F.array_join(F.transform("m", lambda x: x["l_partkey"].cast("string")), ",").alias("members"), "n")


@query("""WITH pairs AS (SELECT DISTINCT l_suppkey AS supplier, p_brand AS brand FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT supplier, count(*) AS brands FROM pairs GROUP BY supplier HAVING count(*) = (SELECT count(DISTINCT p_brand) FROM part)""")
def relational_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that serve every brand, as an implementation has to have every method."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), "l_partkey")
    have = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("supplier").agg(F.count_distinct("brand").alias("brands"))
    need = part.agg(F.count_distinct("brand").alias("need"))
    return have.join(F.broadcast(need), F.col("brands") == F.col("need")).select("supplier", "brands")


@query(f"""WITH {NODES_SQL}, tiers AS (SELECT id, path, CASE kind WHEN 'region' THEN 0 WHEN 'nation' THEN 1 ELSE 2 END AS tier FROM nodes WHERE kind <> 'order')
SELECT id, tier, CAST(row_number() OVER (ORDER BY tier, path, id) AS INTEGER) AS place FROM tiers ORDER BY tier, path, id LIMIT 100""")
def search_rank_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by rank of their kind, then path and id; 100 of them."""
    tier = F.when(F.col("kind") == "region", 0).when(F.col("kind") == "nation", 1).otherwise(2)
    found = nodes(spark, sf_dir).where("kind <> 'order'").select("id", "path", tier.alias("tier"))
    return aggregates.top(found, [F.asc("tier"), F.asc("path"), F.asc("id")], 100).drop("path")
