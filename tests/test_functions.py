"""Scalar expressions and operators on small hand-made rows."""

from __future__ import annotations

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from tessellar.functions import ident
from tessellar.functions import predicates as p
from tessellar.functions import text as tx
from tessellar.operators import aggregates, diff, forest, intervals, lookup, records, rules, traversal


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_identity_frames_bytes(spark):
    parts = ["a", "", "日本", "x" * 300]
    want = hashlib.sha256(b"".join(struct.pack("<Q", len(s.encode())) + s.encode() for s in parts)).hexdigest()
    assert value(spark, ident.identity(*map(F.lit, parts))) == want
    assert value(spark, ident.stable_id("k", F.lit("v"))).startswith("k:")


@pytest.mark.parametrize(
    ("path", "taken", "kind"),
    [
        ("src/lib.rs", True, None), ("target/x.rs", False, None), ("docs/a.txt", True, "documentation"), ("notes.txt", False, None), ("README.txt", True, "documentation"),
        ("package-lock.json", False, "configuration"), (".cargo/config", True, "configuration"), ("Cargo.lock", True, "lockfile"), ("requirements-dev.txt", True, "manifest"),
        ("a/Dockerfile.dev", True, "deployment"), ("q.SQL", True, "schema"), (".gitignore", True, None), ("deploy/x.bin", False, "deployment"),
    ],
)
def test_paths(spark, path, taken, kind):
    assert value(spark, p.admitted(F.lit(path))) is taken
    assert value(spark, p.artifact_kind(F.lit(path))) == kind


def test_small_predicates(spark):
    assert [value(spark, p.is_code(F.lit(x))) for x in ("rate_limited", "ab", "Not", "a" * 25, "a.b")] == [True, False, False, False, True]
    assert [value(spark, p.is_internal_path(F.lit(x))) for x in ("/healthz/x", "/api/health", "ping")] == [True, False, True]
    assert [value(spark, p.http_method(F.lit(x))) for x in ("Method::GET", "get")] == ["GET", None]
    assert [value(spark, p.looks_like_route(F.lit(x))) for x in ("/a/{id}", "a/b", "/a b")] == [True, False, False]


def test_text(spark):
    assert value(spark, tx.compact(F.lit("a . b( c )\n  d"), 40)) == "a.b(c) d"
    assert value(spark, tx.single_line(F.lit(" a\n b\x07 c "), 3)) == "a b…"
    assert value(spark, tx.markdown(F.lit("a*b[c]"))) == "a\\*b\\[c\\]"
    assert [value(spark, tx.join_path(F.lit(a), F.lit(b))) for a, b in (("a/b", "../c"), ("a", "../../c"), ("a", "/c"), ("", "./x"))] == ["a/c", None, None, "x"]
    assert [value(spark, tx.short_path(F.lit(x))) for x in ("a/b/mod.rs", "a/b.rs", "mod.rs")] == ["b/mod.rs", "b.rs", "mod.rs"]
    assert value(spark, tx.byte_position(F.lit("é1"), F.lit(1))) == 2


NODES = "id string, kind string, name string, qualified string, parent string, path string, package string"


def test_lookup_stages(spark):
    nodes = spark.createDataFrame([("1", "f", "go", "a.go", None, "a", "p"), ("2", "f", "gone", "a.gone", "1", "a", "p"), ("3", "f", "x", "go", None, "b", "q")], NODES)
    assert [r.id for r in lookup.find_nodes(nodes, "go").collect()] == ["3"]
    assert [r.id for r in lookup.find_nodes(nodes, "gon", 5).collect()] == ["2"]
    assert lookup.find_nodes(nodes, "100%").count() == 0
    second = lookup.page(nodes, [F.asc("id")], 1, 1).first()
    assert (second.id, second.total, second.truncated) == ("2", 3, True)
    assert [(r.id, r.ancestor) for r in forest.ancestors(nodes).collect()] == [("2", "1")]


def test_multiset_diff(spark):
    schema = "key string, v string"
    before = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), ("c", "1"), (None, "1")], schema)
    after = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), ("d", "1")], schema)
    got = {tuple(r) for r in diff.multiset_diff(before, after, "key", ["v"]).collect()}
    assert got == {("a", "removed", 1), ("b", "modified", 1), ("c", "removed", 1), ("d", "added", 2), (None, "removed", 1)}
    assert {tuple(r) for r in diff.by_key(before.where("key is not null"), after, "key", "v").collect()} == {("a", "modified"), ("b", "modified"), ("c", "removed"), ("d", "added")}


def test_comparisons_deal_rows_to_tasks_by_their_number(spark, monkeypatch):
    """However few partitions a shuffle has, no task of a comparison groups more than about TASK_ROWS rows."""
    monkeypatch.setattr(diff, "TASK_ROWS", 25, raising=False)
    rows = spark.range(300).select(F.col("id").cast("string").alias("key"), (F.col("id") % 3).alias("v"))
    for df in (diff.multiset_diff(rows, rows.where("v > 0"), "key", ["v"]), diff.by_key(rows, rows.where("v > 0"), "key", "v"), diff.one_sided(rows, rows.where("v > 0"), ["key", "v"])):
        assert df.rdd.getNumPartitions() == 20 and df.count() == 100


def test_owners_deal_paths_to_ranges(spark, monkeypatch):
    """However many paths a folder holds, no task gets more than a range of them; prefixes above a range reach it."""
    monkeypatch.setattr(rules, "TASK_ROWS", 40, raising=False)
    rng = random.Random(5)
    odd = ["a", "a-b", "a b", "a\x00b", "a\x01", "\x01\x02", "b", "é", "", "a.b", "日"]
    asked = ["/".join(rng.choice(odd) for _ in range(rng.randint(1, 6))) for _ in range(600)] + [f"hot/{i}" for i in range(400)] + ["", "/", None]
    owning = [*rng.sample(asked[:600], 60), "hot", "hot/17", "", "a", "a", "/", None, "no/such"]
    for some in (owning, [p for p in owning if p]):
        out = rules.owners(spark.createDataFrame([(p,) for p in asked], "path string"), spark.createDataFrame([(p,) for p in some], "prefix string"))
        want = set()
        for path in {p for p in asked if p is not None}:
            parts = path.split("/")
            above = {"", *("/".join(parts[:i]) for i in range(1, len(parts) + 1))} & set(some)
            want |= {(path, max(above, key=len))} if above else set()
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        held = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert max(held) <= 120 and len(held) > 8


def test_rules_and_owners(spark):
    paths = spark.createDataFrame([("a/b/c",), ("a/x",), ("z",)], "path string")
    prefixes = spark.createDataFrame([("a",), ("a/b",), ("",)], "prefix string")
    assert {tuple(r) for r in rules.owners(paths, prefixes).collect()} == {("a/b/c", "a/b"), ("a/x", "a"), ("z", "")}
    assert [r.path for r in rules.members(paths, ["a/*"], ["*/x"]).collect()] == ["a/b/c"]
    nodes = spark.createDataFrame([("1", "ui/a.rs"), ("2", "db/b.rs")], "id string, path string")
    edges = spark.createDataFrame([("1", "2", "calls"), ("2", "1", "calls"), ("1", None, "calls")], "source string, target string, kind string")
    declared = [(0, "ui/*", "db/?.rs"), (1, "*", "db/*"), (2, "db.b.rs", "*")]
    found = rules.violations(edges.withColumn("id", F.concat_ws(">", "source", "target")), nodes, declared)
    assert {(r.position, r.source, r.target) for r in found.collect()} == {(0, "1", "2"), (1, "1", "2")}
    assert [(r.place, r.position, r.total, r.truncated) for r in rules.first_findings(found, 1).collect()] == [(1, 0, 2, True)]


def test_intervals(spark):
    points = spark.createDataFrame([("k", 5), ("k", 50)], "key string, at long")
    spans = spark.createDataFrame([("k", 0, 100, "outer"), ("k", 4, 8, "inner")], "key string, start long, end long, name string")
    assert {(r.at, r.name) for r in intervals.innermost(points, spans, "key").collect()} == {(5, "inner"), (50, "outer")}
    right = spark.createDataFrame([("k", 5, 1), ("k", 40, 2)], "key string, at long, v long")
    assert {(r.at, r.v) for r in intervals.preceding(points, right, "key", "at", "v").collect()} == {(5, 1), (50, 2)}


def test_reach_and_hops(spark):
    edges = spark.createDataFrame([("e1", "a", "b"), ("e2", "a", "c"), ("e3", "a", None), ("e4", "b", "a"), ("e5", "c", "d")], "id string, source string, target string")
    found = traversal.reach(edges, spark.createDataFrame([("a",)], "id string"))
    assert {(r.id, r.depth) for r in found.collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    hops = traversal.two_hops(edges, spark.createDataFrame([("d",)], "id string"))
    assert {(r.caller, r.hops, r.via) for r in hops.collect()} == {("c", 1, "c"), ("a", 2, "c")}


def test_records(spark):
    log = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "only")], "id string, revision long, claim string")
    assert {(r.id, r.claim) for r in records.latest(log, "id", "revision").collect()} == {("k", "new"), ("j", "only")}
    keys = spark.createDataFrame([("k",), ("new",)], "id string")
    assert {tuple(r) for r in records.next_revision(log, keys, "id", "revision").collect()} == {("k", 3), ("new", 1)}


def test_caps(spark):
    rows = spark.createDataFrame([("k", i) for i in range(5)], "key string, v int")
    got = aggregates.first_of_each(rows, ["key"], [F.asc("v")], 2).collect()
    assert [(r.v, r.total, r.truncated) for r in sorted(got, key=lambda r: r.v)] == [(0, 5, True), (1, 5, True)]


def test_shared_tables(spark):
    from pathlib import Path

    from tessellar import storage

    kept = storage.keep(spark.range(3).withColumn("x", F.lit(None).cast("string")), "t")
    assert kept.schema.names == ["id", "x"] and kept.count() == 3
    assert storage.keep(kept.limit(0), "t").count() == 0
    folder = Path(storage.tables_dir(spark).removeprefix("file://"))
    assert folder.is_dir()
    storage.clear(spark)
    assert not folder.exists()


def test_shared_folder_where_none_is_set(spark):
    from types import SimpleNamespace

    from tessellar import storage

    held = {"conf": SimpleNamespace(get=lambda k, d: None), "sparkContext": SimpleNamespace(getCheckpointDir=lambda: held["dir"], setCheckpointDir=lambda x: held.update(dir=x)), "dir": None}
    held["sparkContext"].master = "local[2]"
    fake = SimpleNamespace(**{k: held[k] for k in ("conf", "sparkContext")})
    first = storage.shared_dir(fake)
    assert first.startswith("file:///") and storage.shared_dir(fake) == first
    held["sparkContext"].master, held["dir"] = "spark://host:7077", None
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(fake)
    assert storage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir", None).rstrip("/")


def test_mentions(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "xone two three four five sixth"), (2, "one two three four five six"), (3, "a b"), (4, "one  two three four five six"), (5, None)], "id int, text string")
    declared = spark.createDataFrame([("long", "one two three four five six"), ("short", "a b"), ("part", "ne two three four five six"), ("gone", None), ("none", "one two six")], "name string, needle string")
    from tessellar.operators import mentions

    declared = declared.unionByName(spark.createDataFrame([("piece", "four f"), ("eight", "three four"), ("one", "x"), ("empty", ""), ("twice", "b")], "name string, needle string"))
    want = {(1, "long"), (2, "long"), (3, "short"), (1, "part"), (2, "part"), (1, "one"), (2, "one"), (4, "one"), (3, "twice")}
    want |= {(k, name) for k in (1, 2, 4) for name in ("piece", "eight")}
    for limit in (mentions.BROADCAST_BYTES, 0):
        monkeypatch.setattr(mentions, "BROADCAST_BYTES", limit)
        found = [(r.id, r.name) for r in mentions.literal(texts, declared, "text", "needle").collect()]
        assert sorted(found) == sorted(want)


def test_budget(spark):
    rows = [("a", k, n) for k, n in enumerate([3, 0, 4, 0, 5, 9, 1])] + [("b", 1, 2), (None, 7, 20), (None, 8, 1)]
    got = aggregates.within_budget(spark.createDataFrame(rows, "key string, at int, n long"), "key", "at", "n", 10).collect()
    assert {(r.key, r.at, r.used, r.taken) for r in got} == {("a", 0, 3, 3), ("a", 1, 3, 0), ("a", 2, 7, 4), ("a", 3, 7, 0), ("a", 4, 12, 3), ("b", 1, 2, 2), (None, 7, 20, 10)}


def test_positions_and_references(spark):
    text = F.lit("ä b\n\nx needle é")
    found = value(spark, tx.evidence_of(text, F.lit("needle")))
    assert (found.start_byte, found.end_byte, found.line, found.column) == (8, 14, 3, 3)
    assert value(spark, tx.evidence_of(text, F.lit("absent"))) is None
    for reference, lines, want in (("f#L2-L9", 9, ("f", 2, 9)), ("f#L3", 9, ("f", 3, 3)), ("f#L2-L9", 8, None), ("f#L5-L4", 9, None), ("f", 9, None), ("f#L0", 9, None)):
        got = value(spark, tx.narrowed(F.lit(reference), F.lit(lines)))
        assert (got and tuple(got)) == want
    assert value(spark, tx.path_link(F.lit("a b/ü*~.rs"))) == "a%20b/%C3%BC%2A~.rs"


def test_scope_predicates(spark):
    from tessellar.functions import scope

    for path, want in (("src/a.rs", True), ("a/.git/b.py", False), ("vendor/x.py", False), ("README.MD", True), ("x/Cargo.toml", True), ("cargo.toml", False), ("a.txt", False)):
        assert value(spark, scope.explanation_material(F.lit(path))) is want, path
    for call, want in (("std::env::var", True), ("open", True), ("opened", False), ("os.path", False), ("subprocess.run", True)):
        assert value(spark, scope.runtime_boundary(F.lit(call))) is want
    for a, b, want in (("a/b", "a", True), ("a", "a/b", True), ("ab", "a", False), ("x", "x", True)):
        assert value(spark, scope.paths_related(F.lit(a), F.lit(b))) is want


def test_inspect(spark):
    nodes = spark.createDataFrame([(f"n{k}", "p", f"p/n{k}", "same" if k > 2 else f"name{k}", "f", None) for k in range(30)], "id string, package string, qualified string, name string, kind string, path string")
    edges = spark.createDataFrame([(f"e{k:02d}", "n1", f"n{k % 30}", "calls") for k in range(60)] + [("x", "n5", "n1", "calls")], "id string, source string, target string, kind string")
    out = lookup.inspect(nodes, edges, "name1").collect()
    assert [r.section for r in out].count("outgoing") == 50 and all(r.truncated for r in out if r.section == "outgoing")
    assert [r.id for r in out if r.section == "incoming"] == ["e01", "e31", "x"]
    source = spark.createDataFrame([("n1", k, f"{k} " + "x" * 700) for k in range(1, 61)] + [("n2", 1, "other")], "id string, line int, text string")
    marks = spark.createDataFrame([("n1", "current"), ("n2", "needs review")], "id string, state string")
    shown = lookup.inspect(nodes, edges, "name1", source=source, marks=marks).where("section in ('snippet', 'mark')").collect()
    lines = sorted((r.place, r.other, r.truncated) for r in shown if r.section == "snippet")
    assert lines == [(k, (f"{k} " + "x" * 700)[:600], True) for k in range(1, 46)]
    assert [(r.id, r.other) for r in shown if r.section == "mark"] == [("n1", "current")]
    several = lookup.inspect(nodes, edges, "same").collect()
    assert len(several) == 20 and all(r.section == "candidate" and r.truncated for r in several)


def test_publishing_is_all_or_nothing(spark, tmp_path):
    from tessellar import storage

    path = str(tmp_path / "nodes")
    with pytest.raises(ValueError, match="nothing"):
        storage.published(spark, path)
    assert [storage.publish(spark.range(n), path) for n in (2, 3)] == [1, 2]
    with pytest.raises(Exception, match="broken"):
        storage.publish(spark.range(4).select(F.raise_error(F.lit("broken")).cast("long").alias("id")), path)
    assert storage.published(spark, path).count() == 3 and storage.published(spark, path, 1).count() == 2
    assert storage.publish(spark.range(5), path) == 3


def test_two_writers_of_versions(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from tessellar import storage

    path = str(tmp_path / "shared")
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda n: (storage.publish(spark.range(n), path), n), range(1, 7)))
    assert sorted(v for v, _ in made) == list(range(1, 7))
    assert all(storage.published(spark, path, v).count() == n for v, n in made)
    storage.put_version(spark.range(1), path, 9)
    with pytest.raises(storage.VersionTaken):
        storage.put_version(spark.range(2), path, 9)
    assert storage.next_version(spark, path) == 10 and storage.published(spark, path).count() == 1


@pytest.mark.parametrize("width", [3, 40, 1 << 40])
def test_intervals_in_bins(spark, width):
    import random

    rng = random.Random(4)
    spans = [(f"k{rng.randrange(3)}", a, a + rng.randrange(0, width if i % 5 == 0 else 40), f"s{i}") for i in range(60) for a in [rng.randrange(-50, 50)]]
    points = [(f"k{rng.randrange(3)}", rng.randrange(-60, 100)) for _ in range(80)]
    s = spark.createDataFrame(spans, "key string, start long, end long, name string")
    got = {(r.key, r.at): (r.start, r.name) for r in intervals.innermost(spark.createDataFrame(sorted(set(points)), "key string, at long"), s, "key").collect()}
    want = {}
    for k, at in set(points):
        held = [(a, n) for key, a, b, n in spans if key == k and a <= at < b]
        if held:
            want[k, at] = max(held)
    assert got == want
    others = s.selectExpr("key", "name as other", "start as from", "end as to")
    rows = intervals.overlapping(s.withColumnRenamed("name", "id"), others, "key", 10_000).collect()
    pairs = {(n1, n2) for k1, a1, b1, n1 in spans for k2, a2, b2, n2 in spans if k1 == k2 and a2 < b1 and b2 > a1 and a1 < b1 and a2 < b2}
    assert len(rows) == len(pairs) and {(r.id, r.other) for r in rows} == pairs


def test_only_ascii_is_folded(spark):
    assert [value(spark, p.holds(F.lit(t), "%K\u00e4se\\_%")) for t in ("a k\u00e4SE_b", "K\u00c4SE_", "\u212a\u00e4se_", "k\u00e4sex")] == [True, False, False, False]


def test_declared_routes(spark):
    from tessellar.functions import routes

    for decorator, want in (
        ('@app.get("/items/{id}")', [("GET", "/items/{id}")]), ("@app.route('/a', methods=['get', \"post\"])", [("GET", "/a"), ("POST", "/a")]), ('@app.websocket("/ws")', [("WS", "/ws")]),
        ('@router.api_route("/b")', [("GET", "/b")]), ('@app.get("relative")', []), ("@cached", []), ("@app.get()", []), ('@app.other("/x")', []), (' @@put("/p", name=\'n\')', [("PUT", "/p")]),
    ):
        assert [tuple(r) for r in value(spark, routes.decorator_routes(F.lit(decorator)))] == want, decorator
    for attribute, want in (
        ('#[get("/x")]', ("GET", "/x")), ('#[actix_web::post("/y", name = "n")]', ("POST", "/y")), ('#[route("/z", method = "GET")]', ("", "/z")), ('#[any("/w")]', ("ANY", "/w")),
        ('#[get("x")]', None), ("#[derive(Debug)]", None), ('get("/x")', None), ("#[get]", None),
    ):
        found = value(spark, routes.attribute_route(F.lit(attribute)))
        assert (found and tuple(found)) == want, attribute
    for made, want in (('APIRouter(prefix="/items")', "/items"), ("APIRouter(tags=[1], prefix = '/a/b')", "/a/b"), ('APIRouter(prefix="items")', ""), ("APIRouter()", "")):
        assert value(spark, routes.router_prefix(F.lit(made))) == want
    assert value(spark, routes.joined_route(F.lit("/a//"), F.lit("/b"))) == "/a/b"
    assert value(spark, routes.router_name(F.lit("@a.b.get('/')"))) == "a.b" and value(spark, routes.router_name(F.lit("@get('/')"))) is None


def test_dependency_lines(spark):
    text = '[package]\nx = "1"\n[dev-dependencies]\nserde = "1"\n[target.unix.dependencies]\n "serde" = "1"\n[dependencies.tokio]\nversion = "1"\n'
    for alias, want in (("serde", 6), ("tokio", 7), ("x", None), ("version", 8), ("serd", None)):
        assert value(spark, tx.dependency_line(F.lit(text), F.lit(alias))) == want, alias
