"""Prefix scans, forest labels, scope chains, condensed reach, trigrams, maintained counts and line diffs against plain versions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import TABLES
from pyspark.sql import functions as F

from tessellar.operators import aggregates, condense, deltas, forest, intervals, line_diff, scans, scopes, trigrams


def test_scans_split_one_key(spark):
    """One key over many ranges, ranges without values, and null keys."""
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), k, rng.choice([None, None, None, k % 10]) if not 300 < k < 500 else None) for k in range(900)]
    df = spark.createDataFrame(rows, "key string, at int, v int").repartition(6)
    last = {(r.key, r.at): (r.x, r.y) for r in scans.running_last(scans.running_last(df, ["key"], ["at"], "v", "x", ranges=17), ["key"], ["at"], "v", "y", before=True, ranges=5).collect()}
    total = {(r.key, r.at): r.s for r in scans.running_sum(df, ["key"], ["at"], "v", "s", ranges=17).collect()}
    held, sums = {}, {}
    for key, at, v in rows:
        before = held.get(key)
        if v is not None:
            held[key], sums[key] = v, sums.get(key, 0) + v
        assert last[key, at] == (held.get(key), before)
        assert total[key, at] == sums.get(key)
    ranges = scans.dealt(df, ["key"], ["at"], 17).where("key = 'hot'").select("__range").distinct().count()
    assert ranges > 5
    assert sorted((r.n, r.at) for r in scans.numbered(df, ["at"], "n", 9).collect()) == [(k, k) for k in range(900)]
    assert scans.running_last(df.limit(0), ["key"], ["at"], "v", "x").collect() == []


def test_budget_of_a_hot_key(spark):
    rows = [("hot", k, k % 3) for k in range(4000)] + [("b", 1, 5)]
    df = spark.createDataFrame(rows, "key string, at int, n long").repartition(8)
    got = aggregates.within_budget(df, "key", "at", "n", 1000).where("key = 'hot'").agg(F.sum("taken"), F.max("at")).first()
    assert tuple(got) == (1000, 1000)


def test_a_long_span_is_two_rows_at_most(spark):
    spans = spark.createDataFrame([("k", -3, 10**9), ("k", 0, 1 << 40), ("k", 5, 6), ("k", 7, 7)], "key string, a long, b long")
    rows = intervals.placed(spans, "a", "b").groupBy("a", "b").count().collect()
    assert len(rows) == 3 and max(r["count"] for r in rows) <= 2
    points = spark.createDataFrame([("k", p) for p in (-4, -3, 5, 10**9 - 1, 10**9, 1 << 39, (1 << 63) - 2)], "key string, at long")
    met = {(r.at, r.a) for r in intervals.containing(points, spans, ["key"], start="a", end="b").collect()}
    assert met == {(p, a) for p in (-4, -3, 5, 10**9 - 1, 10**9, 1 << 39) for a, b in ((-3, 10**9), (0, 1 << 40), (5, 6)) if a <= p < b}


def tree(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(f"n{k}", f"n{rng.randrange(max(0, k - 9), k)}" if k % 13 else None if k % 2 else "gone") for k in range(1, n)] + [("n0", None)]


def chain_of(parents: dict, node: str) -> list:
    out = []
    while (node := parents.get(node)) in parents:
        out.append(node)
    return out


def test_forest_labels(spark):
    rows = tree(3, 160) + [(f"c{k:04d}", f"c{k - 1:04d}" if k else None) for k in range(300)] + [(f"h{k}", "hub") for k in range(200)] + [("hub", None)]
    parents = dict(rows)
    nodes = spark.createDataFrame(rows, "id string, parent string").repartition(5)
    found = {r.id: r for r in forest.labels(nodes).collect()}
    assert set(found) == set(parents)
    for node, r in found.items():
        above = chain_of(parents, node)
        assert (r.depth, r.root) == (len(above), above[-1] if above else node)
    sizes = Counter(a for n in parents for a in [n, *chain_of(parents, n)])
    assert all(r.leave - r.enter + 1 == 2 * sizes[n] for n, r in found.items())
    got = Counter((r.id, r.ancestor, r.distance) for r in forest.ancestors(nodes).collect())
    assert got == Counter((n, a, k) for n in parents for k, a in enumerate(chain_of(parents, n), 1))


def test_labels_write_little_for_a_flat_forest(spark, monkeypatch):
    """Nodes without children take no part in the rounds."""
    rows, whole = [], forest.keep
    monkeypatch.setattr(forest, "keep", lambda df, name: (kept := whole(df, name), rows.append(kept.count()))[0])
    nodes = spark.range(3001).select(F.col("id").cast("string"), F.when(F.col("id") > 0, F.expr("(id - 1) div 20").cast("string")).alias("parent"))
    found = forest.labels(nodes)
    assert found.where("depth = 3").count() == 3001 - 421 and found.where("id = '0' and enter = 0 and leave = 6001").count() == 1
    assert sum(rows) < 5 * 3001


def test_chain_of_a_thousand(spark):
    nodes = spark.range(1000).select(F.col("id").cast("string"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"))
    found = forest.labels(nodes).withColumn("k", F.col("id").cast("long"))
    assert found.where("depth = k and enter = k and leave = 1999 - k and root = '0'").count() == 1000


def test_cycles_are_refused(spark, monkeypatch):
    monkeypatch.setattr(forest, "MOST_ROUNDS", 6)
    with pytest.raises(ValueError, match="cycle"):
        forest.labels(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "id string, parent string"))
    assert forest.labels(spark.createDataFrame([], "id string, parent string")).collect() == []


def reached(pairs, start, depth=10**9):
    out, front = {start}, [start]
    while front and depth:
        front = [t for s in front for t in pairs[s] if t not in out and not out.add(t)]
        depth -= 1
    return out - {start}


def graphs():
    rng = random.Random(2)
    scattered = [(rng.randrange(40), rng.randrange(40)) for _ in range(48)]
    rings = [(100 + k, 100 + (k + 1) % 7) for k in range(7)] + [(103, 110), (110, 111), (111, 110), (111, 120), (120, 121), (5, 100)]
    chain = [(200 + k, 201 + k) for k in range(5)]
    hub = [(1000, 2000 + k) for k in range(10_000)] + [(20_000 + k, 1000) for k in range(3)] + [(2000, 2001), (2001, 2002)]
    return scattered + rings + chain + hub + [(7, 7), (None, 3), (3, None)]


def test_condensed_reach(spark):
    rows = graphs()
    pairs = defaultdict(list)
    for s, t in rows:
        if None not in (s, t) and s != t:
            pairs[s].append(t)
    sources = set(pairs)
    everyone = {x for s, ts in pairs.items() for x in [s, *ts]}
    edges = spark.createDataFrame(rows, "source long, target long").repartition(4)
    component = {r.id: r.component for r in condense.components(condense.pairs_of(edges)).collect()}
    small = [x for x in everyone if x < 1000]
    far = {x: reached(pairs, x) for x in small}
    for x in small:
        assert {y for y in small if component[y] == component[x]} == {x} | {y for y in far[x] if x in far.get(y, ())}
    for limit in (400, 5):
        got = {r.id: r for r in condense.bounded_reach(edges, limit).collect()}
        assert set(got) == everyone
        for x in [*small, 1000, 2000, 2001, 2002, 20_001]:
            want = far[x] if x in far else reached(pairs, x)
            assert got[x].reach == min(len(want), limit), x
            assert got[x].members is None if len(want) >= limit else set(got[x].members) == want | {x}
    for limit in (400, 4):
        near = {r.id: r.reach for r in condense.near_reach(edges, limit, 2).collect()}
        assert set(near) == sources
        assert all(n == min(len(reached(pairs, x, 2)), limit) for x, n in near.items())
    assert condense.bounded_reach(edges.limit(0), 400).collect() == []


def test_reach_takes_few_rounds_on_long_paths(spark, monkeypatch):
    """A path of 700, then a crowd with a way back to its end; rounds grow as the logarithm of the limit."""
    rows = [(k, k + 1) for k in range(700)] + [(700, 1000 + k) for k in range(50)] + [(1000 + k, 2000 + (7 * k + j) % 90) for k in range(50) for j in range(9)] + [(2000, 650)]
    pairs = defaultdict(list)
    for s, t in rows:
        pairs[s].append(t)
    rounds = []
    monkeypatch.setattr(condense, "keep", lambda df, name, real=condense.keep: rounds.append(name) or real(df, name))
    edges = spark.createDataFrame(rows, "source long, target long").repartition(3)
    balls = condense.balls(edges, 100)
    assert rounds.count("reach-state") <= 9
    for r in condense.reach_of(balls, 100).collect():
        want = reached(pairs, r.id)
        assert r.reach == min(len(want), 100) and (r.members is None if len(want) >= 100 else set(r.members) == want | {r.id})
    rounds.clear()
    got = condense.whole_reach(edges, balls, spark.createDataFrame([(0,), (640,), (2001,)], "id long")).collect()
    assert rounds.count("reach-open") <= 30 and len(got) == len(set(got))
    for seed in (0, 640, 2001):
        assert {r.id for r in got if r.seed == seed} == reached(pairs, seed) | {seed}


def plain_binding(scope, name, up, kinds, redirects, bindings, hops):
    at, caller = scope, scope
    for k in range(hops):
        if at is None or at not in kinds:
            return ("unbound", None)
        if redirects.get(at):
            at = redirects[at]
            continue
        if kinds[at] != "type" or at == caller:
            own = [b for b in bindings if b[0] == at]
            if any(b[1] == "*" for b in own):
                return ("blocked", k)
            hits = [b for b in own if b[1] == name]
            if hits:
                return ("ambiguous" if len(hits) > 1 else "bound" if hits[0][5] else "conditional", k)
        at = up[at]
    return ("unbound", None)


SCOPES, BINDINGS = "id string, parent string, kind string, redirect string", "scope string, name string, kind string, target string, node string, unconditional boolean"


@pytest.mark.parametrize("hops", [128, 3])
def test_scope_chains(spark, hops):
    rng = random.Random(4)
    rows = [("m", None, "module", None)]
    for k in range(1, 90):
        parent = rows[rng.randrange(max(0, k - 6), k)][0]
        rows.append((f"s{k}", parent, rng.choice(["type", "function", "function", "block"]), parent if rng.random() < 0.15 else None))
    rows += [(f"d{k}", f"d{k - 1}" if k else "m", "function", None) for k in range(200)]
    names = ["x", "y", "z", "w"]
    bindings = [(rng.choice(rows[:90])[0], rng.choice(names), rng.choice(["function", "import_symbol"]), "t", "n", rng.random() < 0.7) for _ in range(90)]
    bindings += [(rows[k][0], "*", "import_symbol", "t", None, True) for k in (7, 30)] + [("m", "deep", "function", "", "n", True)]
    calls = [(k, rng.choice(rows)[0], rng.choice(names)) for k in range(300)] + [(1000 + k, f"d{k}", "deep") for k in (0, 126, 127, 199)]
    up, kinds, redirects = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}, {r[0]: r[3] for r in rows}
    got = scopes.nearest_bindings(spark.createDataFrame(calls, "id int, scope string, name string"), spark.createDataFrame(rows, SCOPES), spark.createDataFrame(bindings, BINDINGS), hops)
    found = {r.id: (r.state, r.distance) for r in got.collect()}
    assert found == {i: plain_binding(s, n, up, kinds, redirects, bindings, hops) for i, s, n in calls}
    assert {s for s, _ in found.values()} >= {"bound", "unbound"}


def test_resolved_calls(spark):
    tree = spark.createDataFrame([("m", None, "module", None), ("f", "m", "function", None), ("c", "m", "type", None), ("g", "c", "function", None), ("o", None, "module", None), ("h", "o", "function", None), ("i", "o", "function", None)], SCOPES)
    bindings = spark.createDataFrame([
        ("m", "f", "function", "", "f", True), ("m", "h", "import_symbol", "o.h", None, True), ("m", "o", "import_module", "o", None, True), ("m", "p", "import_symbol", "o", None, True),
        ("m", "q", "import_symbol", "m.f", None, True), ("c", "g", "function", "", "g", True), ("o", "h", "function", "", "h", True), ("o", "i", "function", "", "i", False),
    ], BINDINGS)
    definitions = spark.createDataFrame([("m", "m", "module", "m", None), ("o", "o", "module", "o", None), ("f", "m.f", "function", "f", "m"), ("g", "m.c.g", "function", "g", "c"), ("h", "o.h", "function", "h", "o"), ("i", "o.i", "function", "i", "o")], "id string, qualified string, kind string, name string, parent string")
    asked = {"f": "f", "h": "h", "o.h": "h", "p.h": "h", "q.h": None, "o.i": None, "h.x": None, "f()": None, "": None, "g": None, "unknown": None, "o..h": None}
    calls = spark.createDataFrame([(k, "g", n) for k, n in enumerate(asked)], "id int, scope string, name string")
    assert {r.name: r.target for r in scopes.resolve(calls, tree, bindings, definitions).collect()} == asked


ROWS = "id long, name string, qualified string"


def test_trigrams(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcABC_%é") for _ in range(rng.randint(1, 9)))
    rows = [(k, None if k % 40 == 0 else word(), "" if k % 33 == 0 else f"{word()}::{word()}") for k in range(400)]
    index = trigrams.build(spark.createDataFrame(rows, ROWS).repartition(3), ["name", "qualified"], ["qualified", "id"])
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    plain = lambda rows, part: Counter(r for r in rows if low(part) in low(r[1]) or low(part) in low(r[2]))
    for part in ("abc", "AbCa", "b", "::", "a%", "_a", "é", "zzz", "ab_c", ":: "):
        assert Counter(map(tuple, trigrams.search(index, spark, part).collect())) == plain(rows, part), part
    gone, added = [r for r in rows if r[0] % 3 == 0], [(1000 + k, word(), word()) for k in range(50)] + [(3, "abcabc", "new")]
    later = trigrams.updated(index, spark.createDataFrame([(r[0],) for r in gone], "id long"), spark.createDataFrame(added, ROWS), "id", ["qualified", "id"])
    rows = [r for r in rows if r[0] % 3] + added
    for part in ("abc", "ca", "new", "B_"):
        assert Counter(map(tuple, trigrams.search(later, spark, part).collect())) == plain(rows, part), part


def test_a_search_reads_candidate_blocks_only(spark, monkeypatch):
    monkeypatch.setattr(trigrams, "ROWS_A_BLOCK", 50)
    index = trigrams.build(spark.range(5000).select("id", F.concat(F.lit("row "), F.format_string("%05d", "id")).alias("name")), ["name"], ["id"])
    found = trigrams.search(index, spark, "w 01234")
    assert [r.id for r in found.collect()] == [1234]
    assert re.search(r"PartitionFilters: \[.*__block#\d+L? = 24", found._jdf.queryExecution().toString())
    posted = spark.read.parquet(*index.postings).where("gram = '123'")
    assert "PushedFilters: [IsNotNull(gram), EqualTo(gram,123)]" in posted._jdf.queryExecution().toString()


def test_counts_after_many_changes(spark):
    rng = random.Random(9)
    nodes = {k: f"p{rng.randrange(4)}" for k in range(40)}
    edges = Counter((f"e{k}", rng.randrange(45), rng.randrange(45), rng.choice("ab")) for k in range(120))
    frames = lambda: (spark.createDataFrame(list(edges.elements()), "id string, source long, target long, kind string"), spark.createDataFrame(list(nodes.items()), "id long, package string"))

    def recount():
        return Counter((nodes[s], nodes[t], kind) for (_, s, t, kind), n in edges.items() for _ in range(n) if s in nodes and t in nodes and nodes[s] != nodes[t])

    keys, before = ["source_package", "target_package", "kind"], frames()
    stored = spark.createDataFrame([(*k, n) for k, n in recount().items()], "source_package string, target_package string, kind string, n long")
    paths = deltas.counted(before[1], ["package", "id"])
    for step in range(4):
        for k in rng.sample(sorted(nodes), 5):
            nodes[k] = f"p{rng.randrange(5)}"
        nodes.pop(rng.choice(sorted(nodes)))
        nodes[50 + step] = nodes[rng.choice(sorted(nodes))]
        for e in rng.sample(sorted(edges), 12):
            del edges[e]
        for k in range(10):
            edges[(f"x{step}{k}", rng.randrange(55), rng.randrange(55), "c")] += 1 + k % 2
        after = frames()
        stored = deltas.folded(stored, deltas.relation_change(*[x for pair in zip(before, after) for x in pair]), keys)
        paths = deltas.folded(paths, deltas.signed(before[1], after[1]), ["package", "id"])
        stored, before = spark.createDataFrame(stored.collect(), stored.schema), after
        paths = spark.createDataFrame(paths.collect(), paths.schema)
        assert {(r[0], r[1], r[2]): r.n for r in stored.collect()} == dict(recount())
    held = defaultdict(list)
    for k, p in nodes.items():
        held[p].append(k)
    assert {r.package: (r.members, r.ids, r.first_id) for r in deltas.described(paths, "package", "id").collect()} == {p: (len(k), len(k), min(k)) for p, k in held.items()}


def test_line_diffs(spark):
    rng = random.Random(10)
    line = lambda: rng.choice(["", "a", "b", "c = 1", "}", "return x", f"line {rng.randrange(60)}"])
    pairs = [("null", None, None), ("new", None, "a\nb"), ("old", "a\nb\n", ""), ("same", "x\ny", "x\ny"), ("end", "a", "a\n"), ("swap", "a\nb\nc\nd\n", "c\nd\na\nb\n"), ("one", "x\n" * 50, "x\n" * 20)]
    for k in range(25):
        old = [line() for _ in range(rng.randrange(1, 90))]
        new = [x for x in old if rng.random() > 0.1]
        for _ in range(rng.randrange(8)):
            new.insert(rng.randrange(len(new) + 1), line())
        if k % 5 == 0:
            new = new[len(new) // 2 :] + new[: len(new) // 2]
        pairs.append((f"r{k}", "\n".join(old) + "\n" * (k % 2), "\n".join(new) + "\n"))
    ops = line_diff.diff(spark.createDataFrame(pairs, "key string, before string, after string"), "key", "before", "after").cache()
    split = lambda t: (t or "").removesuffix("\n").split("\n") if t else []
    found = {r.key: (r.before, r.after) for r in line_diff.patched(ops).collect()}
    assert found == {k: (split(a), split(b)) for k, a, b in pairs if (a or "") != (b or "")}
    counts = {(r.key, r.op): r["count"] for r in ops.groupBy("key", "op").count().collect()}
    assert counts["one", " "] == 20 and counts["swap", " "] == 2 and ("new", "-") not in counts and ("end", "+") not in counts
    unchanged = sum(n for (k, op), n in counts.items() if op == " " and k.startswith("r"))
    import difflib

    best = sum(m.size for k, a, b in pairs if k.startswith("r") for m in difflib.SequenceMatcher(None, split(a), split(b), autojunk=False).get_matching_blocks())
    assert unchanged >= 0.8 * best


def test_bounds_of_a_shown_diff(spark):
    old = [f"l{k}" for k in range(400)]
    new = [x + "!" if k % 10 == 5 else x for k, x in enumerate(old)]
    wide = "w" * 900
    pairs = [("many", "\n".join(old), "\n".join(new)), ("wide", "a", wide), ("few", "\n".join(old), "\n".join(old[:200] + ["new"] + old[200:]))]
    shown = {r.key: r for r in line_diff.bounded(line_diff.diff(spark.createDataFrame(pairs, "key string, before string, after string"), "key", "before", "after")).collect()}
    assert len(shown["many"].diff) == 160 and shown["many"].truncated and (shown["many"].added, shown["many"].removed) == (40, 40)
    assert shown["many"].diff[:9] == ["@@", " l2", " l3", " l4", "-l5", "+l5!", " l6", " l7", " l8"]
    assert shown["wide"].diff == ["-a", "+" + wide[:800]] and shown["wide"].truncated
    assert shown["few"].diff == ["@@", " l197", " l198", " l199", "+new", " l200", " l201", " l202"] and not shown["few"].truncated


def test_lines_of_suppliers_that_share_a_name(spark, tmp_path):
    from tessellar.plans import QUERIES

    rows = [(1, 7, "a", 1.0), (2, 7, "a", 2.0), (3, 7, "b", 3.0), (4, 7, "a", -1.0), (5, 8, "b", 0.0)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey long, s_name string, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    found = QUERIES["dependency_lines"](spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in found) == Counter([(7, "a", 4), (7, "a", 5), (7, "b", 6), (7, "a", None), (8, "b", 4)])


def test_one_search_builds_no_index(spark, monkeypatch):
    from tessellar.plans import QUERIES

    monkeypatch.setattr(trigrams, "build", lambda *a: pytest.fail("an index for one search"))
    monkeypatch.setattr(scans, "dealt", lambda *a: pytest.fail("all nodes are sorted for one search"))
    assert QUERIES["search_exact_first"](spark, TABLES).count() > 0


def test_spans_of_like_lengths_share_a_level(spark):
    spans = spark.range(33, 121).select(F.lit(0).alias("start"), F.col("id").alias("end"))
    assert intervals.levels(spans) == [8]
    assert intervals.levels(spark.sql("select 0L as start, 9223372036854775807L as end")) == [63]


def test_relation_change_of_edges_that_their_ends_tell_apart(spark):
    """Number keys and no id: an edge that goes is counted out, one that stays is not counted."""
    nodes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id long, package string")
    edges = spark.createDataFrame([(0, 1, "k"), (0, 2, "k")], "source long, target long, kind string")
    found = deltas.relation_change(edges, edges.where("target = 1"), nodes, nodes)
    assert [tuple(r) for r in found.collect()] == [("a", "c", "k", -1)]
