"""Content, paths, lines and excerpts of the document-like tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions import text as tx
from ..operators import aggregates, mentions
from .registry import query
from .views import LINKS_SQL, links, table


@query("SELECT doc_id, sha256(text) AS digest, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("SELECT sha256(text) AS hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1")
def blob_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each content; rows are hashed before they travel."""
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return hashed.groupBy("hash").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))


@query(r"""SELECT source, count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes,
  CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines, CAST(count(*) FILTER (text = '') AS BIGINT) AS empty FROM documents GROUP BY source""")
def snapshot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"),
        F.sum(F.size(tx.lines(F.col("text")))).cast("long").alias("n_lines"), F.count_if(F.col("text") == "").alias("empty"),
    )


ENDINGS = ["/page.md", "/page.py", "/Dockerfile", "/package-lock.json", "/docs/readme.txt", "/page.bin"]
PATH_SQL = f"regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+/', ''), '/*([?#].*)?$', '') || ({ENDINGS!r})[page_id % 6 + 1]"


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a file path: its URL path with a file name by its id."""
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("page_id") % 6 + 1).cast("int"))
    base = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]+/", ""), "/*([?#].*)?$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(base, ending).alias("path"))


@query(f"""WITH f AS (SELECT page_id, {PATH_SQL} AS path, string_split(path, '/')[-1] AS name FROM pages)
SELECT page_id, path, regexp_matches(path, '\\.(md|py)$') OR name = 'Dockerfile' OR regexp_matches(path, '(^|/)docs/.*\\.txt$') AS admitted,
  CASE WHEN regexp_matches(name, '^package-lock\\.json$') THEN 'configuration' WHEN name = 'Dockerfile' THEN 'deployment' WHEN regexp_matches(name, '\\.md$') OR regexp_matches(path, '(^|/)docs/') THEN 'documentation' END AS kind,
  name AS short, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END AS parent FROM f""")
def path_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return page_paths(spark, sf_dir).select("page_id", "path", p.admitted(path).alias("admitted"), p.artifact_kind(path).alias("kind"), tx.short_path(path).alias("short"), tx.parent_path(path).alias("parent"))


@query(f"""WITH {LINKS_SQL} SELECT DISTINCT href, regexp_matches(href, '^/[A-Za-z0-9/_\\-{{}}*:.<>]{{0,254}}$') AS route,
  string_split(regexp_replace(href, '^/+', ''), '/')[1] IN ('health','healthz','ready','readyz','live','livez','internal','metrics','debug','status','ping','_internal') AS internal,
  regexp_matches(regexp_replace(href, '^/', ''), '^[a-z][a-z0-9_.]{{2,63}}$') AND (regexp_matches(href, '[_.]') OR length(href) <= 25) AS code FROM links""")
def route_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    href = F.col("href")
    return links(spark, sf_dir).select("href").distinct().select("href", p.looks_like_route(href).alias("route"), p.is_internal_path(href).alias("internal"), p.is_code(F.regexp_replace(href, "^/", "")).alias("code"))


@query("""SELECT user_id, count(*) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) * 10 BETWEEN 400 AND 599) AS errors, count(*) AS n FROM events GROUP BY user_id""")
def status_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose number, read as a status, is an error."""
    code = F.get_json_object("props", "$.k").cast("long") * 10
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(p.is_status(code)).alias("errors"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(r"""SELECT doc_id, CAST(line AS INTEGER) AS line, left(t, 600) AS snippet FROM (
  SELECT doc_id, unnest(ls) AS t, unnest(range(1, len(ls) + 1)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE line BETWEEN 3 AND 47""")
def line_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 45 lines from the third on, each cut to 600 characters."""
    part = F.slice(tx.lines(F.col("text")), 3, 45)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(part).alias("i", "t")).select("doc_id", (F.col("i") + 3).alias("line"), tx.short(F.col("t"), 600).alias("snippet"))


@query(r"""SELECT doc_id, left(trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '```') AND NOT starts_with(trim(x), '#'))[1]), 400) AS excerpt FROM documents""")
def excerpt_first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line with content that is neither a fence nor a heading; null where there is none."""
    some = F.filter(tx.lines(F.col("text")), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("```") & ~F.trim(x).startswith("#"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.short(F.trim(F.get(some, 0)), 400).alias("excerpt"))


def decoration(line: Column) -> Column:
    x = F.trim(line)
    starts = F.lit(False)
    for head in ("#", "![", "[![", "<", "- ", "* ", "| ", "[!"):
        starts = starts | x.startswith(head)
    return starts | x.rlike(r"^[=\-* ]*$")


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
d AS (SELECT doc_id, ls, list_transform(ls, lambda x: regexp_matches(trim(x), '^(#|!\[|\[!\[|<|- |\* |\| |\[!)') OR regexp_matches(trim(x), '^[=\-* ]*$')) AS deco FROM l),
s AS (SELECT doc_id, ls, deco, list_position(deco, false) AS a FROM d)
SELECT doc_id, CAST(a AS INTEGER) AS first_line, CAST(coalesce(nullif(list_position(deco[a:], true), 0) - 1, len(ls) - a + 1) AS INTEGER) AS n_lines FROM s WHERE a > 0""")
def purpose_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first paragraph of prose stands: its first line and how many lines it has. Fences are not in these texts."""
    marks = table(spark, sf_dir, "documents").select("doc_id", F.transform(tx.lines(F.col("text")), decoration).alias("deco"))
    first = F.array_position("deco", F.lit(False)).cast("int")
    tail = F.expr("slice(deco, first_line, size(deco))")
    out = marks.withColumn("first_line", first).where("first_line > 0")
    stop = F.array_position(tail, F.lit(True)).cast("int")
    return out.select("doc_id", "first_line", F.when(stop > 0, stop - 1).otherwise(F.size(tail)).cast("int").alias("n_lines"))


@query("""SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def doc_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a declared text literally and whole."""
    docs, declared = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle"))
    return mentions.literal(docs, declared, "text", "needle").select("doc_id", "item_id")


@query("""SELECT doc_id, source, used, CAST(least(n, 24000 - (used - n)) AS BIGINT) AS taken FROM (
  SELECT doc_id, source, n, CAST(sum(n) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS used FROM (SELECT doc_id, source, least(length(text), 4000) AS n FROM documents)) WHERE used - n < 24000""")
def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source fills a budget of 24,000 characters with its documents in order, at most 4,000 of each; the last is clamped."""
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", F.least(F.length("text"), F.lit(4000)).cast("long").alias("n"))
    return aggregates.within_budget(sized, "source", "doc_id", "n", 24_000).select("doc_id", "source", "used", "taken")


@query(r"""SELECT item_id, left(t, 40) || CASE WHEN length(t) > 40 THEN '…' ELSE '' END AS line, regexp_replace(left(t, 40), '([\\`*_\[\]<>])', '\\\1', 'g') AS md
FROM (SELECT item_id, trim(regexp_replace(text, '[ \t\n]+', ' ', 'g')) AS t FROM benchmark)""")
def single_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "benchmark").select("item_id", F.col("text"))
    one = F.trim(F.regexp_replace("text", "[ \t\n]+", " "))
    return text.select("item_id", tx.single_line(F.col("text"), 40).alias("line"), tx.markdown(F.substring(one, 1, 40)).alias("md"))
