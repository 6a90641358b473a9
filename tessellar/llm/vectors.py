"""What the vector operators share: which vectors count, components as integers, and sums by group that tasks form first."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers stay below this, so that squared distances of 2**9 components fit a long.
MOST = 1 << 26


def finite(vector: Column) -> Column:
    """Is there a vector, without null, NaN or infinite components?"""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x), x as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def largest(vectors: DataFrame, vector: str, scale: int) -> int:
    """The largest absolute value (rounded up) among all components times scale, -1 without any; an error if distances would
    not fit a long."""
    size = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double") * F.lit(float(scale)))))
    found = vectors.agg(F.max(size)).first()[0]
    if found is None:
        return -1
    if found >= MOST:
        raise ValueError(f"components times {scale} have to stay below {MOST}, found {found}")
    return int(np.ceil(found))


def matrix(column: pa.Array, n: int, kind=np.int64) -> np.ndarray:
    """A list column of one length as n rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(n, -1)


def group_sums(rows: DataFrame, kernel: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], groups: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and componentwise sums by group. kernel: batch -> (group of each item, items). A task adds up its own batches and
    hands on a row a group at most; Spark sums those. groups * width numbers reach the driver, whatever the input."""
    schema = pa.schema([("g", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(groups, np.int64), np.zeros((groups, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                group, items = kernel(batch)
                n += np.bincount(group, minlength=groups)
                np.add.at(total, group, items)
        used = np.flatnonzero(n)
        if len(used):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), pa.array(total[used].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), lists], schema=schema)

    part = rows.mapInArrow(run, "g int, n long, total array<long>")
    flat = part.select("g", F.posexplode(F.concat(F.array("n"), "total")).alias("place", "x"))
    out = np.zeros((groups, width + 1), np.int64)
    for r in flat.groupBy("g", "place").agg(F.sum("x").alias("x")).collect():
        out[r.g, r.place] = r.x
    return out[:, 0], out[:, 1:]


def moved(centres: np.ndarray, n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The floor of every used group's mean; unused groups stay where they are."""
    return np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], centres)


def digest(numbers: np.ndarray) -> str:
    """sha256 of decimal integers joined by commas."""
    return sha256(",".join(map(str, numbers.ravel().tolist())).encode()).hexdigest()
