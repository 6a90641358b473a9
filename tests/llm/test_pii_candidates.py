"""Loose candidates depend on their own words alone."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tessellar.llm import boosting, pii
from tessellar.llm.common import documents

FORMS = ["jane at example[dot]com", "jane at example.com", "jane at example(dot)com", "jane at example dot com", "jane(at)example.com", "jane[at]example[dot]com", "jane @ example.com"]


@pytest.mark.parametrize("form", FORMS)
def test_unrelated_text_never_matters(form):
    text = f"write {form}, soon"
    at = text.index(form)
    assert (0, at, at + len(form)) in pii.candidates(text)
    assert pii.candidates(text) == pii.candidates(text + " ; @ ; (at) [at] x dot y")[: len(pii.candidates(text))]


def test_gates_let_every_match_pass():
    rng = random.Random(7)
    parts = ["a", "jo", "at", " at ", "(at)", "[at]", "@", " ", ".", "dot", " dot ", "(dot)", "[dot]", "com", "é", "1", "22", "4444", "-", "+", "(", ")"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        assert pii.candidates(text) == [(k, m.start(), m.end()) for k, p in pii.LOOSE for m in p.finditer(text)], text


def test_every_lesson_teaches_and_sets_the_thresholds(spark, monkeypatch):
    """Trees and thresholds against arrays that hold all lessons of the table."""
    monkeypatch.setattr(pii, "TRAIN_ROWS", 100, raising=False)  # no bound on lessons changes what is learned
    table = documents(spark, "/root/testdata/sf0.01")
    found, spelt = [], set()
    for r in table.collect():
        text = r.text or ""
        base = pii.base_spans(text)
        spelt |= {f"{k}:{pii.spelled(k, text[s:e])}" for k, s, e in base}
        found += [(zlib.crc32(f"{r.doc_id}:{at}".encode()) % 2, *rest) for at, *rest in pii.lessons(text, base, pii.loose_spans(text, base))]
    fold, x = np.array([f[0] for f in found]), np.array([f[1] for f in found])
    agreed = np.array([f[4] in spelt for f in found])
    y, weight = np.array([f[2] for f in found]) | agreed, np.where(agreed, 1.0, [f[3] for f in found])
    y = y.astype(float)
    assert len(found) > 100 and 0 < y.sum() < len(y)

    model, levels = pii.train(table)
    assert model.base == pytest.approx(np.log((y @ weight) / ((1 - y) @ weight)))

    edges = [np.unique(np.quantile(x[:, j], model.levels())) for j in range(x.shape[1])]

    def learned(rows):
        trees, codes = boosting.BoostedTrees(), boosting.binned(x[rows], edges)
        trees.start(np.average(y[rows], weights=weight[rows]))
        boosting.grow([trees], edges, lambda tops, level: [boosting.level_sums(codes, y[rows], weight[rows], trees, tops[0], level, boosting.UNIT) / boosting.UNIT])
        return trees

    assert model.score(x) == pytest.approx(learned(fold >= 0).score(x), abs=1e-6)
    score = np.where(fold == 0, learned(fold == 1).score(x), learned(fold == 0).score(x))
    for kind in range(4):
        own = x[:, 0] == kind
        enough = [s for s in sorted(set(score[own])) if (y * weight)[own & (score >= s)].sum() >= pii.PRECISION * weight[own & (score >= s)].sum()]
        assert levels[kind] == pytest.approx(max(enough[0], 0.5) if enough else 2.0, abs=1e-3)


def test_sums_do_not_depend_on_how_rows_are_dealt(spark):
    """One model a fold and one on all rows, the same however many tasks hold the rows; empty folds are no error."""
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 8, (900, 3)).astype(np.uint8)
    rows = spark.createDataFrame([(i % 2, c.tobytes(), bool((c[0] > 3) == (c[1] > 3)), 1 + i % 4) for i, c in enumerate(codes)], "fold int, codes binary, right boolean, weight long")
    edges = [np.arange(7.0)] * 3
    one, many = (boosting.fit_rows(rows.repartition(n), edges, 2, trees=8) for n in (1, 5))
    for a, b in zip(one, many, strict=True):
        assert [[v.tolist() for v in t] for t in a.grown] == [[v.tolist() for v in t] for t in b.grown]
    y = (codes[:, 0] > 3) == (codes[:, 1] > 3)
    assert all(((m.score(codes) > 0.5) == y).mean() > 0.95 for m in one)
    assert len(boosting.fit_rows(rows.where("fold = 0"), edges, 2, trees=1)) == 3
