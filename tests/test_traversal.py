"""Capped walks against plain breadth-first and depth-first searches over random graphs, with every cap reached."""

from __future__ import annotations

import random
from collections import defaultdict, deque

import pytest

from tessellar.operators import traversal


def graph(seed: int, n: int = 24, m: int = 90) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(f"e{k:03d}", f"n{rng.randrange(n)}", None if rng.random() < 0.1 else f"n{rng.randrange(n)}") for k in range(m)]
    return rows + [(f"f{k:03d}", "n1", f"n{k}") for k in range(16)] + [("g000", "n2", "n1"), ("g001", "x0", "x1"), ("g002", "x1", "x0")]


@pytest.fixture(scope="module", params=[1, 2])
def edges(spark, request):
    rows = graph(request.param)
    return spark.createDataFrame(rows, "id string, source string, target string"), rows


def out_of(rows, near):
    out = defaultdict(list)
    for e in sorted(rows):
        out[e[near]].append(e)
    return out


def walk(rows, seed, depth, max_nodes, max_edges, drop, near=1, far=2):
    out, nodes, kept, cut, queue = out_of(rows, near), [seed], [], False, deque([(seed, 0)])
    while queue:
        at, d = queue.popleft()
        if d == depth:
            cut |= bool(out[at])
            continue
        for e in out[at]:
            if len(kept) >= max_edges:
                cut = True
                break
            other = e[far]
            if other is not None and other not in nodes:
                if len(nodes) >= max_nodes:
                    cut = True
                    if not drop:
                        kept.append(e[0])
                    continue
                nodes.append(other)
                queue.append((other, d + 1))
            kept.append(e[0])
    return nodes, kept, cut


def collected(found):
    nodes, kept = defaultdict(list), defaultdict(list)
    for r in sorted(found.nodes.collect(), key=lambda r: r.place):
        nodes[r.seed].append(r.id)
    for r in sorted(found.edges.collect(), key=lambda r: r.place):
        kept[r.seed].append(r.id)
    return nodes, kept, {r.seed for r in found.cut.collect()}


@pytest.mark.parametrize(("depth", "max_nodes", "max_edges", "drop"), [(3, 60, 120, False), (3, 5, 12, False), (2, 4, 20, True), (3, 100, 7, True), (2, 1, 3, False), (10, 100, 500, True)])
def test_capped_walk(spark, edges, depth, max_nodes, max_edges, drop):
    df, rows = edges
    seeds = [f"n{k}" for k in range(0, 24, 3)] + ["x0", "absent"]
    nodes, kept, cut = collected(traversal.capped_walk(df, spark.createDataFrame([(s,) for s in seeds], "id string"), depth, max_nodes, max_edges, drop))
    for s in seeds:
        assert (nodes[s], kept[s], s in cut) == walk(rows, s, depth, max_nodes, max_edges, drop), s
    if depth == 10:  # a cycle of two: two nodes, two edges, nothing cut
        assert (nodes["x0"], kept["x0"]) == (["x0", "x1"], ["g001", "g002"]) and "x0" not in cut


def test_capped_walk_meets_no_more_edges_than_are_left(spark, edges, monkeypatch):
    """A level of a walk meets the edges that can still have a place and one more, not all edges of its nodes."""
    met, keep = [], traversal.keep
    monkeypatch.setattr(traversal, "keep", lambda df, name: met.append((name, keep(df, name))) or met[-1][1])
    df, rows = edges
    traversal.capped_walk(df, spark.createDataFrame([(f"n{k}",) for k in range(24)], "id string"), 3, 60, 7)
    levels = [kept.groupBy("seed").count().agg({"count": "max"}).first()[0] for name, kept in met if name == "walk-level"]
    assert levels and max(n or 0 for n in levels) <= 8


def test_trace_keeps_room_after_the_node_cap(spark):
    """Edges dropped at the node cap leave room for later edges between known nodes."""
    rows = [(f"a{k:02d}", "n0", f"n{k}") for k in (1, 2)] + [(f"b{k:02d}", "n1", f"m{k}") for k in range(16)] + [("c00", "n2", "n1")]
    df = spark.createDataFrame(rows, "id string, source string, target string")
    _, kept, cut = collected(traversal.trace(df, spark.createDataFrame([("n0",)], "id string"), 2, 3))
    assert kept["n0"] == ["a01", "a02", "c00"] and cut == {"n0"}


def test_trace_of_callers(spark, edges):
    df, rows = edges
    _, kept, cut = collected(traversal.trace(df, spark.createDataFrame([("n1",), ("n5",)], "id string"), 2, 4, incoming=True))
    known = [e for e in rows if e[2] is not None]
    for s in ("n1", "n5"):
        assert (kept[s], s in cut) == walk(known, s, 2, 4, 20, True, 2, 1)[1:]


def test_reach_capped(spark, edges):
    df, rows = edges
    known = [e for e in rows if e[2] is not None]
    seeds = ["n0", "n1", "x0"]
    for limit in (400, 3):
        nodes, _, _ = collected(traversal.reach_capped(df, spark.createDataFrame([(s,) for s in seeds], "id string"), limit))
        for s in seeds:
            assert nodes[s] == walk(known, s, 99, limit + 1, 10**6, False)[0]


def plain_impact(rows, seed, limit):
    into, queue, seen, out, cut = out_of([e for e in rows if e[2] is not None], 2), deque([(seed, (), 0)]), set(), [], False
    while queue:
        at, path, d = queue.popleft()
        if at in seen:
            continue
        seen.add(at)
        calls = into[at][: limit + 1]
        if d >= 2:
            cut |= any(e[1] not in seen for e in calls)
            continue
        for e in calls:
            if e[1] in seen:
                continue
            if len(out) >= limit:
                cut = True
                break
            out.append((e[1], d + 1, (*path, e[0])))
            queue.append((e[1], (*path, e[0]), d + 1))
        if cut:
            break
    return out, cut


@pytest.mark.parametrize("limit", [30, 4, 1])
def test_impact(spark, edges, limit):
    df, rows = edges
    seeds = [f"n{k}" for k in range(0, 24, 2)] + ["x0"]
    found, cut = traversal.impact(df, spark.createDataFrame([(s,) for s in seeds], "id string"), limit)
    got, cut = defaultdict(list), {r.seed for r in cut.collect()}
    for r in sorted(found.collect(), key=lambda r: r.place):
        got[r.seed].append((r.caller, r.hops, tuple(r.via)))
    for s in seeds:
        assert (got[s], s in cut) == plain_impact(rows, s, limit), s


def plain_routes(rows, seed, depth, fan, limit):
    out, found, cut = out_of([e for e in rows if e[2] is not None], 1), [], [False]

    def go(at, path):
        nexts = out[at]
        if not nexts or len(path) > depth:
            cut[0] |= bool(nexts)
            found.append(path)
            return
        cut[0] |= len(nexts) > fan
        for e in nexts[:fan]:
            if e[2] in path:
                found.append([*path, e[2]])
            else:
                go(e[2], [*path, e[2]])

    go(seed, [seed])
    return found[:limit], cut[0] or len(found) > limit


@pytest.mark.parametrize(("depth", "fan", "limit"), [(3, 3, 64), (6, 2, 5), (2, 6, 10)])
def test_routes(spark, edges, depth, fan, limit):
    df, rows = edges
    seeds = ["n0", "n1", "n7", "x0", "absent"]
    found, _ = traversal.routes(df, spark.createDataFrame([(s,) for s in seeds], "id string"), depth, fan, limit)
    got = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: r.place):
        got[r.seed].append(r.route)
    for s in seeds:
        assert got[s] == plain_routes(rows, s, depth, fan, limit)[0], s


def test_first_above_and_expanded(spark):
    parents = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("z", "z")], "id string, parent string")
    wanted = spark.createDataFrame([("c", "here"), ("e", "far"), ("b", None)], "id string, value string")
    start = spark.createDataFrame([("a",), ("c",), ("d",), ("z",)], "id string")
    got = {r.id: (r.value, r.distance) for r in traversal.first_above(start, parents, wanted, 2).collect()}
    assert got == {"a": ("here", 2), "c": ("here", 0), "d": ("far", 1), "z": (None, None)}
    children = parents.toDF("parent", "child")
    paths = {(tuple(r.path), r.again) for r in traversal.expanded(start, children, 2).collect()}
    assert paths == {(("a",), False), (("a", "b"), False), (("a", "b", "c"), False), (("c",), False), (("c", "d"), False), (("c", "d", "e"), False), (("d",), False), (("d", "e"), False), (("z",), False), (("z", "z"), True)}


def test_neighbourhoods(spark):
    rng = random.Random(8)
    rows = [(k, rng.randrange(6), None if rng.random() < 0.3 else rng.randrange(12), rng.choice(["resolved", "external", "unresolved"]), rng.randrange(1000)) for k in range(150)]
    rows += [(200 + k, 20 + k % 5, 30 + k % 3 if k % 4 else 21, "resolved", 7) for k in range(60)] + [(300 + k, 50, 60 + k, "resolved", k) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, source long, target long, resolution string, start_byte long").cache()
    seeds = {"many": [0, 1, 2, 3], "one": [5], "leaf": [11], "same": [20, 20, 21], "wide": [50, 0], "none": [99]}
    want = {}
    for name, entries in seeds.items():
        queue, seen, unknown, cut = deque((e, 0) for e in entries[:3]), [], [], len(entries) > 3
        while queue:
            node, d = queue.popleft()
            if node in seen:
                continue
            if len(seen) >= 9:
                cut = True
                break
            seen.append(node)
            own = sorted(r for r in rows if r[1] == node)
            if d >= 2:
                cut |= bool(own)
                continue
            cut |= len(own) > 24
            for r in sorted(own[:24], key=lambda r: (r[4], r[0])):
                if r[2] is not None:
                    if len(queue) < 12:
                        queue.append((r[2], d + 1))
                    else:
                        cut = True
                elif r[3] != "external" and len(unknown) < 4:
                    unknown.append(r[0])
        want[name] = (seen, unknown, cut)
    entries = spark.createDataFrame([(s, k, e) for s, es in seeds.items() for k, e in enumerate(es)], "seed string, place int, id long")
    assert {r.seed: (r.visited, r.unknown, r.cut) for r in traversal.neighbourhoods(df, entries).collect()} == want
