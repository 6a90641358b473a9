"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

One pass turns each text into FEATURES numbers (counts as logarithms, shares as square roots, so that their spread is
closer to normal). Class counts, sums and cross products are one aggregate over the labelled rows. A class covariance is
shrunk towards the pooled one and that towards its mean diagonal; its Cholesky factor is inverted once, and a text's
score is the logistic of the difference of the two log densities and log priors, each density a Mahalanobis length
through the cached factor.

Learning uses labelled rows whose crc32(doc_id as text) mod 4 is not 2; language, source and ids are no inputs. Null
text is empty. Rows with a null label are not learned from; a label given twice counts twice; without rows of both
labels every score is the share of label 1 (0.5 without labels). Rows that repeat a doc_id are scored each, and each is
learned from where its id is labelled; texts that tie get equal scores; very long texts take time in proportion; extra
columns of both tables are ignored. Empty input gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_stats as st
from .common import BLANKS, crc_bucket, keep, map_texts

FEATURES = 11
#: Share of the pooled covariance in a class's own, share of the mean variance in that, and the least variance.
POOLED, RIDGE, LEAST = 0.1, 0.02, 1e-4
THRESHOLD = 0.7


def features(text: str | None) -> list[float]:
    text = text or ""
    data = text.encode()
    words = data.split()
    n = max(len(words), 1)
    ids, distinct = st.word_ids(words)
    lines, same = st.dup_lines(text)
    digits = len(data) - len(data.translate(None, b"0123456789"))
    return [
        math.log1p(len(words)),
        math.log1p(st.word_chars(text) / n),
        math.sqrt(st.n_symbols(text) / n),
        math.sqrt(same / max(lines, 1)),
        math.sqrt(st.repeat_words(ids, distinct) / n),
        math.sqrt(st.upper_share(data)),
        math.sqrt(text.count("!") / n),
        distinct / n if words else 1.0,
        math.sqrt((text.count(",") + text.count(".")) / n),
        math.log1p(len(text.strip(BLANKS)) / max(lines, 1)),
        math.sqrt(digits / max(len(data), 1)),
    ]


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id, f0 .. f10."""

    def run(cols: dict) -> dict:
        found = np.array([features(x) for x in cols["text"]])
        return {"doc_id": cols["doc_id"], **{f"f{i}": found[:, i] for i in range(FEATURES)}}

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, " + ", ".join(f"f{i} double" for i in range(FEATURES)))


def fit(rows: DataFrame) -> list[tuple[float, np.ndarray, np.ndarray, float]]:
    """rows: f0 .., label 0/1. For each label: log prior, mean, inverse Cholesky factor, log determinant."""
    f = [F.col(f"f{i}") for i in range(FEATURES)]
    sums = [F.sum(a).alias(f"s{i}") for i, a in enumerate(f)]
    cross = [F.sum(f[i] * f[j]).alias(f"c{i}_{j}") for i in range(FEATURES) for j in range(i, FEATURES)]
    got = {r["label"]: r for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *sums, *cross).collect()}
    total = sum(r["n"] for r in got.values())
    means, scatter = {}, {}
    for k, r in got.items():
        means[k] = np.array([r[f"s{i}"] for i in range(FEATURES)]) / r["n"]
        c = np.zeros((FEATURES, FEATURES))
        for i in range(FEATURES):
            for j in range(i, FEATURES):
                c[i, j] = c[j, i] = r[f"c{i}_{j}"] / r["n"]
        scatter[k] = c - np.outer(means[k], means[k])
    if set(got) != {0, 1}:
        return [(math.log(max(got[k]["n"] / total, 1e-12)) if k in got else (0.0 if not got else -27.0), np.zeros(FEATURES), np.zeros((FEATURES, FEATURES)), 0.0) for k in (0, 1)]
    pooled = sum(got[k]["n"] / total * scatter[k] for k in (0, 1))
    model = []
    for k in (0, 1):
        c = (1 - POOLED) * scatter[k] + POOLED * pooled
        c = (1 - RIDGE) * c + RIDGE * np.diag(np.full(FEATURES, np.trace(c) / FEATURES)) + LEAST * np.eye(FEATURES)
        factor = np.linalg.cholesky(c)
        model.append((math.log(got[k]["n"] / total), means[k], np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum())))
    return model


def probability(x: np.ndarray, model: list) -> np.ndarray:
    logs = [prior - 0.5 * (((x - mean) @ factor.T) ** 2).sum(1) - 0.5 * det for prior, mean, factor, det in model]
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    found = keep(document_features(docs).withColumn("bucket", crc_bucket("doc_id", 4)), "quality-features")
    known = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1))
    model = fit(found.where("bucket <> 2").join(known, F.col("doc_id") == F.col("__id")))

    def score(cols: dict) -> dict:
        x = np.array([cols[f"f{i}"] for i in range(FEATURES)], float).T
        p = probability(x, model)
        return {"doc_id": cols["doc_id"], "held_out": [b == 2 for b in cols["bucket"]], "score": p, "predicted": (p >= THRESHOLD).astype(np.int32)}

    return map_texts(found, score, "doc_id long, held_out boolean, score double, predicted int")
