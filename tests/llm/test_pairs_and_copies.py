"""Exact dedup, n-gram join and substring index against brute force on small, awkward tables."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from conftest import TABLES, duck

from tessellar import storage
from tessellar.llm import exact_index, ngram_join, queries, substring_index
from tessellar.llm.common import documents

BLANKS = " \t\n\r\x0b\x0c"
SCHEMA = "doc_id long, text string, key string, source string"


def split(text):
    out, word = [], ""
    for c in text or "":
        if c in BLANKS:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def awkward():
    """Near copies, shared passages, equal texts, nulls, blanks, a very long text, repeated ids, and ties."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    rows, passage = [], [word() for _ in range(60)]
    for i in range(12):
        base = [word() for _ in range(rng.randint(60, 140))]
        for k in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(k * 2):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows) * 3, " ".join(copy).upper() if k == 1 else "\t".join(copy)))
        rows.append((len(rows) * 3 + 1, " ".join([word() for _ in range(rng.randint(0, 200))] + passage + [word() for _ in range(30)])))
    rows += [(900, None), (901, ""), (902, " \n "), (903, "one two"), (904, "one  two"), (905, "ONE two"), (906, " ".join(word() for _ in range(9000)) + " " + " ".join(passage))]
    rows += [(3, "again " + " ".join(passage)), (907, "a" * 5000), (None, " ".join(passage)), rows[0], ("5", None)]
    rows = [(None if d is None else int(d), t, "key", "s") for d, t in rows]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_exact_dedup(docs, rows):
    body = lambda t: "".join(" " if c in BLANKS else c for c in (t or ""))

    def norm(t):
        out = ""
        for c in body(t):
            if not (c == " " and out.endswith(" ")):
                out += c
        return out

    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[norm(t)].append(d)
    want = []
    for d, t, *_ in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        want.append((d, keep, len(ids), d == keep, sha256(norm(t).encode()).hexdigest()))
    got = [tuple(r) for r in exact_index.exact_dedup(docs, capacity=4).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    kept = exact_index.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(d for d, _, _, k, _ in want if k and d is not None)


@pytest.mark.parametrize("capacity", [1, 64, 5000])
def test_directory_doubles_only_where_full(spark, capacity):
    """Every bucket is one range of keys; it holds no more than capacity, and its parent would hold more."""
    keys = spark.range(2000).selectExpr("case when id < 1900 then id when id < 1950 then -id else shiftleft(id, 53) end as key").distinct()
    levels = exact_index.directory(keys, capacity)
    rows = exact_index.routed(keys, levels).collect()
    assert len(rows) == keys.count() and (len(levels) == 4) == (capacity < 1900)
    unsigned = [(r.key % 2**64, r.depth, r.bucket % 2**64) for r in rows]
    held = defaultdict(list)
    for k, depth, bucket in unsigned:
        assert bucket <= k < bucket + 2 ** (64 - depth)
        held[depth, bucket].append(k)
    assert all(len(v) <= capacity for v in held.values())
    for depth, bucket in held:
        if depth:
            width = 2 ** (65 - depth)
            assert sum(bucket // width == k // width for k, _, _ in unsigned) > capacity


@pytest.mark.parametrize("hot", [1, 256])
def test_chains_part_texts_of_one_key(spark, monkeypatch, hot):
    """A hash of the length alone: different texts share keys, and the owner's comparison tells them apart."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_index, "HOT", hot)
    monkeypatch.setattr(exact_index.F, "xxhash64", lambda c: F.length(c).cast("long"))
    rows = [(k, "ab"[k % 2] * (k % 5) + "c" * (k % 3)) for k in range(90)]
    digests, index = exact_index.build_index(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    got = {r.sha.hex(): r for r in index.collect()}
    groups = defaultdict(list)
    for k, t in rows:
        groups[sha256(t.encode()).hexdigest()].append(k)
    assert {s: (r.keep_id, r.group_size) for s, r in got.items()} == {s: (min(v), len(v)) for s, v in groups.items()}
    chains = defaultdict(list)
    for r in got.values():
        chains[r.key].append(r.chain)
    assert all(sorted(c) == list(range(len(c))) for c in chains.values()) and max(map(len, chains.values())) > 1


def jaccard_components(rows):
    sets = []
    for _, t, *_ in rows:
        w = split(folded(t))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i in range(len(rows)):
        ids[find(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(repr((rows[i][0], len(sets[i]), least[find(i)])) for i in range(len(rows)))


@pytest.mark.parametrize(("frequent", "block", "limit"), [(ngram_join.FREQUENT, 1500, 600_000), (1, 1500, 0), (2, 2, 600_000)])
def test_jaccard(docs, rows, monkeypatch, frequent, block, limit):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)  # few: nearly all documents that share a token are dense
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    got = sorted(repr(tuple(r)) for r in ngram_join.jaccard_components(docs).collect())
    assert got == jaccard_components(rows)


@pytest.mark.parametrize("frequent", [1, 4, 32])
def test_prefix_shares_a_signature(spark, monkeypatch, frequent):
    """Sets at the very threshold, with every common token frequent, still meet in the second join."""
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    rng = random.Random(5)
    pool = list(range(1, 400))
    rows, sets = [], []
    for v in range(40):
        base = rng.sample(pool, 45) if v % 2 == 0 else list(sets[-1])
        if v % 2:
            for x in rng.sample(base, 5):
                base.remove(x)
            base += rng.sample([p for p in pool if p not in base], 5)
        sets.append(base)
        rows += [(v, len(base), t * 7919) for t in base]
    lists = ngram_join.dense_lists(spark.createDataFrame(rows, "v long, n long, token long")).collect()
    held = defaultdict(set)
    for r in lists:
        held[r.v].add(r.token)
    for i in range(40):
        for j in range(i):
            inter = len(set(sets[i]) & set(sets[j]))
            if 100 * inter >= 80 * (90 - inter):
                assert held[i] & held[j]


def windows_removed(rows):
    first = defaultdict(set)
    for d, t, *_ in rows:
        w = split(t)
        for i in range(len(w) - 49):
            first[tuple(w[i : i + 50])].add(d)
    out = []
    for d, t, *_ in rows:
        w, gone = split(t), set()
        for i in range(len(w) - 49):
            if d is not None and any(x is not None and x < d for x in first[tuple(w[i : i + 50])]):
                gone.update(range(i, i + 50))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append(repr((d, len(w), len(gone), sha256(" ".join(kept).encode()).hexdigest())))
    return sorted(out)


@pytest.mark.parametrize(("batches", "limit"), [(1, 500_000), (4, 0)])
def test_substring_index(docs, rows, monkeypatch, batches, limit):
    monkeypatch.setattr(substring_index, "BROADCAST_ROWS", limit)
    got = sorted(repr(tuple(r)) for r in substring_index.dedup_substrings(docs, batches).collect())
    assert got == windows_removed(rows)


@pytest.mark.parametrize("fanout", [2, 3])
def test_batches_in_separate_calls(spark, rows, tmp_path, fanout):
    """The index is opened anew for every batch; verdicts come batch by batch and equal brute force; runs are compacted."""
    ids = sorted({r[0] for r in rows if r[0] is not None})
    parts = [ids[k * len(ids) // 5 : (k + 1) * len(ids) // 5] for k in range(5)]
    so_far, got, merged = [], [], 0
    for part in parts:
        batch = [r for r in rows if r[0] in part]
        so_far += batch
        frame = spark.createDataFrame(batch, SCHEMA)
        index = substring_index.SubstringIndex(spark, str(tmp_path / "index"), fanout)
        levels = [level for kind, level, _ in index.runs if kind == "entries"]
        assert len(levels) <= 2 * fanout and all(levels.count(n) <= fanout for n in levels)
        cuts = index.add(substring_index.entries(frame), spark.createDataFrame(so_far, SCHEMA))
        got += [repr(tuple(r)) for r in substring_index.without_repeats(frame, cuts).collect()]
        merged = max(merged, *[level for _, level, _ in index.runs])
    got += [repr(tuple(r)) for r in substring_index.without_repeats(spark.createDataFrame([r for r in rows if r[0] is None], SCHEMA), cuts).collect()]
    assert sorted(got) == windows_removed(rows) and merged >= 1


def test_two_writers_of_an_index(spark, rows, tmp_path):
    frame = spark.createDataFrame(rows[:12], SCHEMA)
    one, two = (substring_index.SubstringIndex(spark, str(tmp_path / "index")) for _ in range(2))
    one.add(substring_index.entries(frame), frame)
    with pytest.raises(storage.VersionTaken):
        two.add(substring_index.entries(frame), frame)
    assert substring_index.SubstringIndex(spark, str(tmp_path / "index")).runs == one.runs


LEAST, MOST = -(2**63), 2**63 - 1


def extremes():
    """Ids at both ends of a long, texts of a megabyte, and a near copy of one."""
    rng = random.Random(12)
    numbers = [str(rng.randrange(10**6)) for _ in range(150_000)]
    near = list(numbers)
    near[70_000:70_020] = ["changed"] * 20
    rows = [(MOST, " ".join(numbers)), (LEAST, " ".join(near)), (0, "same " * 200_000), (2**62, "x" * 1_000_000), (-5, " ".join(numbers[1000:1100])), (7, "x" * 1_000_000), (8, None)]
    return [(d, t, "key", "s") for d, t in rows]


def test_extreme_ids_and_long_texts(spark):
    rows = extremes()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(repr(tuple(r)) for r in substring_index.dedup_substrings(frame).collect())
    assert got == windows_removed(rows)
    linked = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame).collect()}
    assert linked[MOST][1] == linked[LEAST][1] == LEAST and linked[2**62] == (1, 7) and linked[0] == (1, 0) and linked[8] == (0, 8) and linked[-5][1] == -5
    copies = {r.doc_id: (r.keep_id, r.group_size) for r in exact_index.exact_dedup(frame).collect()}
    assert copies == {MOST: (MOST, 1), LEAST: (LEAST, 1), 0: (0, 1), 2**62: (7, 2), -5: (-5, 1), 7: (7, 2), 8: (8, 1)}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    df = queries.QUERIES[name](spark, TABLES)
    found = duck().execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    order = [names.index(c) for c in sorted(names)]
    want = sorted(repr([r[i] for i in order]) for r in found.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr([r[c] for c in sorted(names)]) for r in df.collect()) == want


@pytest.mark.parametrize("call", [exact_index.exact_dedup, ngram_join.jaccard_components, substring_index.dedup_substrings, ngram_join.one_of_each, exact_index.drop_copies])
def test_empty(spark, call):
    assert call(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table_is_read(spark):
    assert queries.QUERIES["op10_exact_index"](spark, TABLES).count() == documents(spark, TABLES).count()


@pytest.mark.parametrize("hot", [32, 0])
def test_token_lists_shuffle_rows_once(spark, monkeypatch, hot):
    """One token of every document, passages of a few, and tokens of one; counted the same way whatever is hot."""
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rows = [(v, pos, token) for v in range(3000) for pos, token in enumerate([-1, v // 3, 10_000 + v])]
    index = spark.createDataFrame(rows, "v long, pos int, token long").repartition(5)
    lists = ngram_join.token_lists(index)
    df = Counter(r[2] for r in rows)
    assert Counter(map(tuple, lists.select("v", "pos", "token", "df").collect())) == Counter((v, p, t, df[t]) for v, p, t in rows if df[t] > 1)
    moved = [x for x in lists._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x]
    assert not any("SortMergeJoin" in x for x in moved)
    assert ngram_join.token_lists(index.limit(0)).collect() == []
