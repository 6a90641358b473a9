"""Connected components against union-find."""

from __future__ import annotations

import random

import pytest

from tessellar.llm.components import components


@pytest.mark.parametrize("links", [
    [], [(2, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(99, i) for i in range(1, 30)],
    [(a, b) for a in range(8) for b in range(a)] + [(20, 7), (7, 20), (20, 21)], [(random.Random(i).randrange(60), 60 + random.Random(-i).randrange(60)) for i in range(70)],
])
def test_components(spark, links):
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.v: r.component for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
