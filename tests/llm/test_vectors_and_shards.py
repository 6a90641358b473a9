"""Bit planes, limb products and the sharding permutation against brute force on small, awkward tables."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from tessellar.llm import bit_planes, sharding, vector_codes, vectors

VECTORS = "vec_id long, embedding array<float>, label int, cluster string, code string"
NAN, INF = float("nan"), float("inf")


def awkward(seed: int, n: int = 260) -> list[tuple]:
    """Copies, equal ids, ids at both ends, nulls, odd lengths and broken components."""
    rng = random.Random(seed)
    make = lambda: [float(np.float32(rng.gauss(rng.choice((-1, 0, 1)), 0.4))) for _ in range(64)]
    rows = [(i * 3, make(), rng.choice((None, 1, 2, 3))) for i in range(n)]
    rows += [(rng.randrange(9), rows[5][1], 7) for _ in range(90)]  # one vector, a quarter of the rows
    rows += [(None, make(), 1), (-(2**63), make(), 2), (2**63 - 1, make(), None), rows[0], rows[1]]
    rows += [(1001, None, 1), (1002, [None] * 64, 1), (1003, [0.5] * 63 + [NAN], 1), (1004, [0.5] * 63 + [INF], 1), (1005, [], 1), (1006, [1.0] * 8, 2), (1007, [1.0] * 65, 2)]
    rng.shuffle(rows)
    return [(*r, "cluster", "code") for r in rows]


def whole(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def least(key):
    """Ids in order, null first."""
    return (key[0] is not None, key[0] or 0, key[1])


def near(v, centres):
    far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
    return far.index(min(far)), min(far)


def means(items, groups, centres):
    out = []
    for k, c in enumerate(centres):
        mine = [v for v, g in zip(items, groups) if g == k]
        out.append([sum(x) // len(mine) for x in zip(*mine)] if mine else c)
    return out


def integers(v, scale):
    return [int(np.floor(np.float64(x) * scale)) for x in v]


def brute_clusters(rows, k, rounds, scale, seed):
    ids, items = zip(*[(r[0], integers(r[1], scale)) for r in rows if whole(r[1]) and len(r[1]) == 64])
    name = lambda i: sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(zip(map(name, ids), items))[:k]]
    for _ in range(rounds):
        centres = means(items, [near(v, centres)[0] for v in items], centres)
    found = [near(v, centres) for v in items]
    held = Counter()
    for c, d in found:
        held[c] += d
    text = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, c, d, held[c], sum(held.values()), text[c]) for i, (c, d) in zip(ids, found))


@pytest.mark.parametrize("bits", [2, 9, 20, 27])
def test_planes_are_exact(bits):
    rng = np.random.default_rng(bits)
    low, high = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
    a, b = (np.vstack([rng.integers(low, high, (n, 64), endpoint=True), np.full((1, 64), low), np.full((1, 64), high)]) for n in (40, 6))
    assert (bit_planes.unpack(bit_planes.pack(a, bits)) == a).all()
    assert (bit_planes.dots(bit_planes.pack(a, bits), bit_planes.pack(b, bits)) == a @ b.T).all()


@pytest.mark.parametrize(("k", "scale"), [(40, 256), (3, 1000), (1, 7)])
def test_clusters(spark, k, scale):
    rows = awkward(k)
    got = bit_planes.cluster_report(spark.createDataFrame(rows, VECTORS).repartition(5), k, 3, scale, 2)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, got.collect())) == brute_clusters(rows, k, 3, scale, 2)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = awkward(8)[:7]
    got = bit_planes.cluster_report(spark.createDataFrame(rows, VECTORS), 40)
    assert Counter(map(tuple, got.collect())) == brute_clusters(rows, 40, 5, 256, 2)
    for nothing in ([], [(1, None, 1, "", ""), (2, [], 1, "", "")]):
        assert bit_planes.cluster_report(spark.createDataFrame(nothing, VECTORS)).collect() == []
        codes = vector_codes.code_report(spark.createDataFrame(nothing, VECTORS)).collect()
        assert [r.code for r in codes] == [None] * len([r for r in nothing if r[1] is not None])


def test_equal_vectors_tie_to_the_smaller_number(spark):
    table = spark.createDataFrame([(i, [0.25] * 64, None, "", "") for i in range(300)], VECTORS).repartition(7)
    assert {(r.cluster, r.distance, r.inertia) for r in bit_planes.cluster_report(table).collect()} == {(0, 0, 0)}
    assert {(r.code, r.error, r.label_error) for r in vector_codes.code_report(table).collect()} == {("00" * 8, 0, 0)}


def test_components_out_of_range_are_refused(spark):
    table = spark.createDataFrame([(1, [3e38] * 64, None, "", "")], VECTORS)
    for report in (bit_planes.cluster_report, vector_codes.code_report):
        with pytest.raises(ValueError, match="have to stay below"):
            report(table)


@pytest.mark.parametrize("most", [1, 2400, (1 << 25) + 3, vectors.MOST])
def test_limbs_are_exact(most):
    rng = np.random.default_rng(most)
    v, c = rng.integers(-most, most, (4, 30, 16), endpoint=True), rng.integers(-most, most, (4, 5, 16), endpoint=True)
    v[:, 0], c[:, 0], c[:, 1] = most, -most, most
    limbs, bits = vector_codes.limb_plan(most, 16)
    assert limbs >= 2 and 16 << (2 * bits) < 1 << 53 and limbs * bits > most.bit_length()
    assert (vector_codes.products(v, c, most) == np.einsum("pnl,pel->pne", v, c)).all()


def brute_codes(rows, parts, entries, rounds, scale):
    kept = [r for r in rows if whole(r[1])]
    width = len(min((r for r in kept if r[1] and len(r[1]) % parts == 0), key=lambda r: least((r[0], integers(r[1], scale))))[1])
    full = sorted(((r[0], integers(r[1], scale), r[2]) for r in kept if len(r[1]) == width), key=least)
    size = width // parts
    pieces = [[v[p * size : (p + 1) * size] for _, v, _ in full] for p in range(parts)]
    books = [mine[:entries] for mine in pieces]
    for _ in range(rounds):
        books = [means(mine, [near(v, book)[0] for v in mine], book) for mine, book in zip(pieces, books)]
    found = [[near(mine[n], book) for mine, book in zip(pieces, books)] for n in range(len(full))]
    out = [(i, "".join(f"{e:02x}" for e, _ in f), sum(d for _, d in f), label) for (i, _, label), f in zip(full, found)]
    out += [(r[0], None, None, r[2]) for r in kept if len(r[1]) != width]
    held: dict = {}
    for _, _, error, label in out:
        held[label] = held.get(label) if error is None else (held.get(label) or 0) + error
    text = sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return Counter((i, code, error, held[label], text) for i, code, error, label in out)


@pytest.mark.parametrize(("parts", "entries", "scale"), [(8, 16, 4096), (4, 5, 1 << 20), (64, 2, 3)])
def test_codes(spark, parts, entries, scale):
    rows = awkward(parts, 150)
    got = vector_codes.code_report(spark.createDataFrame(rows, VECTORS).repartition(4), parts, entries, 3, scale)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == brute_codes(rows, parts, entries, 3, scale)


def test_a_code_is_near_its_vector(spark):
    rows = awkward(1, 100)
    kept, books, most = vector_codes.train(spark.createDataFrame(rows, VECTORS))
    for r in vector_codes.encode(kept, books, most).join(kept.where("v is not null").dropDuplicates(["vec_id"]), "vec_id").where("vec_id between 10 and 1000").collect():
        assert ((np.array(r.v) - vector_codes.decode(r.code, books)) ** 2).sum() == r.error


TEXTS = "doc_id long, text string, size string, own struct<at:int>, row_number int"


def texts() -> list[tuple]:
    rng = random.Random(5)
    rows = [(i * 2, "é" * rng.randrange(30) + "x" * rng.randrange(9)) for i in range(200)]
    rows += [(7, "again")] * 150 + [(7, "other"), (7, None), (None, "no id"), (None, None), (-(2**63), ""), (2**63 - 1, "last"), (9, "long " * 300_000)]
    rng.shuffle(rows)
    return [(d, t, "size", (3,), 4) for d, t in rows]


def test_permutation_and_its_inverse():
    for n in (1, 2, 3, 5, 8, 100, 4097, 70_000):
        place = sharding.permute(np.arange(n), n)
        assert sorted(place.tolist()) == list(range(n))
        assert (sharding.row_at(place % 8, place // 8, n) == np.arange(n)).all()
        assert n < 100 or (place != sharding.permute(np.arange(n), n, 7)).mean() > 0.9
    huge = sharding.permute(np.arange(2**61 - 50, 2**61), 2**61)
    assert (sharding.row_at(huge % 8, huge // 8, 2**61) == np.arange(2**61 - 50, 2**61)).all()
    place = sharding.permute(np.arange(40_000), 40_000)  # neighbours part as in a shuffle
    assert abs(np.corrcoef(np.arange(40_000), place)[0, 1]) < 0.03 and abs((place[1:] % 8 == place[:-1] % 8).mean() - 0.125) < 0.02


def test_placements(spark):
    rows = texts()
    facts = sorted(((d is not None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows))
    place = sharding.permute(np.arange(len(rows)), len(rows)).tolist()
    want = Counter((d if there else None, size, crc, "rows", place[k] % 8, place[k] // 8, None) for k, (there, d, size, crc) in enumerate(facts))
    for parts in (1, 6):
        got = sharding.placements(spark.createDataFrame(rows, TEXTS).repartition(parts))
        found = [tuple(r)[:7] for r in got.collect()]
        assert Counter(found) == want
    slots = defaultdict(list)
    for r in found:
        slots[r[4]].append(r[5])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.placements(spark.createDataFrame([], TEXTS)).collect() == []
    assert [tuple(r)[:6] for r in sharding.placements(spark.createDataFrame(rows[:1], TEXTS)).collect()][0][4:] == (0, 0)


def test_written_shards(spark, tmp_path):
    rows = texts()
    docs = spark.createDataFrame(rows, TEXTS)
    sharding.write_shards(docs, str(tmp_path / "out"), 3)
    read = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.document.doc_id, r.document.text, r.document.own.at) for r in read.collect()) == Counter((d, t, own[0]) for d, t, _, own, _ in rows)
    placed = {(r.shard, r.slot): r.doc_id for r in sharding.placements(docs, 3).collect()}
    assert {(r.shard, r.slot): r.document.doc_id for r in read.collect()} == placed
