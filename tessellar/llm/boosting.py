"""Gradient-boosted trees: logistic loss, quantile bins, trees of fixed depth.

Growing needs no more of the rows than the sums of a level: gradients by node, feature and bin. So rows may lie in arrays
(``fit``) or in Spark's tasks (``fit_rows``: any number of rows, a pass a level, all of them in every pass; a task holds
CHUNK rows). Gradients there are rounded to multiples of 1 / UNIT, whose sums do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = float(1 << 20)
#: Rows that a task works on at once; and tasks at most, each of which sends the driver its sums.
CHUNK, TASKS = 50_000, 64
#: Bins that sums are laid out for, and the bin of a split that sends all rows to the left.
WIDTH, ALL = 32, 255


class BoostedTrees:
    """Trees of ``depth`` levels as arrays: node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = WIDTH, damping: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.damping = trees, depth, rate, bins, damping
        self.base = 0.0
        self.grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # split feature, split value, leaf value
        self.cuts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # the same with the number of the split's bin

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        weight = np.ones(len(y)) if weight is None else weight
        self.start(np.average(y, weights=weight))
        edges = [np.unique(np.quantile(x[:, j], self.levels())) for j in range(x.shape[1])]
        codes = binned(x, edges)
        grow([self], edges, lambda tops, level: [level_sums(codes, y, weight, self, tops[0], level)])
        return self

    def start(self, share: float) -> None:
        share = np.clip(share, 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))

    def levels(self) -> np.ndarray:
        """The quantiles at which bins meet."""
        return np.linspace(0, 1, self.bins + 1)[1:-1]

    def split(self, top: tuple, at: int, sums: np.ndarray) -> None:
        """Split node ``at`` of a tree by its sums (features x bins x 2), and give its children their values on the last level."""
        feature, cut, leaf = top
        gs, hs = whole = sums[0].sum(axis=0)
        left = sums.cumsum(axis=1)[:, :-1]
        gl, hl = left[..., 0], left[..., 1]
        gain = gl**2 / (hl + self.damping) + (gs - gl) ** 2 / (hs - hl + self.damping) - gs * gs / (hs + self.damping)
        below = whole
        if gain.max() > 1e-6:
            feature[at], cut[at] = np.unravel_index(gain.argmax(), gain.shape)
            below = left[feature[at], cut[at]]
        child = 2 * at + 1 - len(feature)
        if child >= 0:
            for k, (g, h) in enumerate((below, whole - below)):
                leaf[child + k] = g / (h + self.damping)

    def add(self, top: tuple, edges: list[np.ndarray]) -> None:
        feature, cut, leaf = top
        self.cuts.append(top)
        self.grown.append((feature, np.array([np.inf if k == ALL else edges[j][k] for j, k in zip(feature, cut, strict=True)]), leaf))

    def raw(self, x: np.ndarray, trees: list[tuple]) -> np.ndarray:
        raw = np.full(len(x), self.base)
        for tree in trees:
            raw += self.rate * tree[2][reached(x, tree, self.depth) - len(tree[0])]
        return raw

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x, self.grown)))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of every value: how many edges lie below it."""
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


def reached(x: np.ndarray, tree: tuple, levels: int) -> np.ndarray:
    """The node of every row after so many levels."""
    feature, value, _ = tree
    node, rows = np.zeros(len(x), int), np.arange(len(x))
    for _ in range(levels):
        node = 2 * node + 1 + (x[rows, feature[node]] > value[node])
    return node


def level_sums(codes: np.ndarray, y: np.ndarray, weight: np.ndarray, model: BoostedTrees, top: tuple, level: int, unit: float | None = None) -> np.ndarray:
    """Sums of gradients by node of a level, feature and bin."""
    nodes, features = 1 << level, codes.shape[1]
    p = 1 / (1 + np.exp(-model.raw(codes, model.cuts)))
    node = reached(codes, top, level) - (nodes - 1)
    cell = ((node[:, None] * features + np.arange(features)) * WIDTH + codes).ravel()
    sums = []
    for each in (y - p, p * (1 - p)):
        each = weight * (np.rint(each * unit) if unit else each)
        sums.append(np.bincount(cell, np.repeat(each, features), nodes * features * WIDTH))
    return np.stack(sums, axis=1).reshape(nodes, features, WIDTH, 2)


def grow(models: list[BoostedTrees], edges: list[np.ndarray], sums: Callable[[list, int], list[np.ndarray]]) -> None:
    """Grow all trees of models of one shape, side by side; sums is asked once a level, for all of them."""
    inner = (1 << models[0].depth) - 1
    for _ in range(models[0].trees):
        tops = [(np.zeros(inner, int), np.full(inner, ALL), np.zeros(inner + 1)) for _ in models]
        for level in range(models[0].depth):
            for model, top, found in zip(models, tops, sums(tops, level), strict=True):
                for i, cells in enumerate(found):
                    model.split(top, (1 << level) - 1 + i, cells)
        for model, top in zip(models, tops, strict=True):
            model.add(top, edges)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of up to about CHUNK rows; codes as a matrix."""
    held, rows = [], 0

    def whole() -> dict[str, np.ndarray]:
        table = pa.Table.from_batches(held)
        out = {c: table[c].to_numpy() for c in table.column_names if c != "codes"}
        return out | {"codes": np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(table.num_rows, -1)}

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            yield whole()
            held, rows = [], 0
    if rows:
        yield whole()


def fit_rows(rows: DataFrame, edges: list[np.ndarray], folds: int, one: int = 1, **shape) -> list[BoostedTrees]:
    """A model for each fold, learned from all rows of the others, and one learned from all rows.
    rows: codes (a byte for each feature), right, weight (long, in parts of which ``one`` make a weight of 1), fold (0, 1, ..)."""
    told = {r.fold: (r.good, r.n) for r in rows.groupBy("fold").agg(F.sum(F.when(F.col("right"), F.col("weight")).otherwise(0)).alias("good"), F.sum("weight").alias("n")).collect()}
    models = [BoostedTrees(**shape) for _ in range(folds + 1)]
    for left_out, model in enumerate(models):
        good, n = (sum(v[i] for fold, v in told.items() if fold != left_out) for i in (0, 1))
        model.start(good / n if n else 0.5)

    def sums(tops: list, level: int) -> np.ndarray:
        size = (len(models), 1 << level, len(edges), WIDTH, 2)

        def run(batches):
            total = np.zeros(size)
            for c in chunks(batches):
                for k, (model, top) in enumerate(zip(models, tops, strict=True)):
                    other = c["fold"] != k
                    total[k] += level_sums(c["codes"][other], c["right"][other].astype(float), c["weight"][other].astype(float), model, top, level, UNIT)
            yield pa.record_batch({"sums": pa.array([total.ravel()], pa.list_(pa.float64()))})

        return sum(np.array(r.sums) for r in rows.mapInArrow(run, "sums array<double>").collect()).reshape(size) / (UNIT * one)

    grow(models, edges, sums)
    return models


def scored(rows: DataFrame, models: list[BoostedTrees]) -> DataFrame:
    """kind, right, weight and raw: the logarithm of the odds that the model without the row's fold gives."""

    def run(batches):
        for c in chunks(batches):
            raw = np.zeros(len(c["fold"]))
            for k, model in enumerate(models[:-1]):
                own = c["fold"] == k
                raw[own] = model.raw(c["codes"][own], model.cuts)
            yield pa.record_batch({"kind": pa.array(c["kind"], pa.int32()), "right": pa.array(c["right"], pa.bool_()), "weight": pa.array(c["weight"], pa.int64()), "raw": pa.array(raw, pa.float64())})

    return rows.mapInArrow(run, "kind int, right boolean, weight long, raw double")
