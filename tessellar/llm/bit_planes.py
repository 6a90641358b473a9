"""Centroid clustering over bit planes.

A vector of 64 integers is kept as its bit planes: word b holds bit b of all 64 components (two's complement; bit 0 of the
word belongs to component 0). With plane weights w (2**b, the sign plane negative) the dot product of two vectors is the sum
of w[i] * w[j] * popcount(plane i AND plane j), exact in 64-bit integers, and |v|**2 - 2 v.c + |c|**2 the squared distance.
The number of planes is what the largest component of the table needs (9 for components below 1 in steps of 1/256), so the
table of planes is about a quarter of the floats that it stands for. It is written once; a round reads it, assigns every
vector, and adds up planes by cluster inside tasks. A cluster that holds most of the rows is a row a task like any other. The driver
holds k centroids of 64 integers.

Defined results: vectors that are null, of another length, or with null or non-finite components have no row. Starting
centroids are the k smallest sha256 of "<seed>:<vec_id>" (equal ids: by components; a null id reads "null"); with fewer
vectors than k there are as many centroids as vectors. Ties go to the smaller number. Rows that repeat count each. No
vector gives an empty result. Columns besides the id and the vector are ignored. Components that reach 2**26 after
scaling raise an error, as their distances would not fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import keep, small_batches

WIDTH = 64
CLUSTERS, ROUNDS, SCALE, SEED = 40, 5, 256, 2
#: Vector-centroid pairs that are held at a time.
PAIRS = 1 << 18


def weights(bits: int) -> np.ndarray:
    w = np.int64(1) << np.arange(bits)
    w[-1] = -w[-1]
    return w


def pack(v: np.ndarray, bits: int) -> np.ndarray:
    """Rows of 64 integers in [-2**(bits - 1), 2**(bits - 1)) -> (rows, bits) words."""
    on = ((v[:, None, :] >> np.arange(bits)[None, :, None]) & 1).astype(np.uint8)
    return np.packbits(on, axis=2, bitorder="little").view("<u8")[..., 0]


def unpack(planes: np.ndarray) -> np.ndarray:
    """The integers back."""
    n, bits = planes.shape
    on = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(n, bits, 8), axis=2, bitorder="little")
    return np.einsum("nbc,b->nc", on.astype(np.int64), weights(bits))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact dot products of every row of planes a with every row of planes b."""
    w, out = weights(a.shape[1]), np.zeros((len(a), len(b)), np.int64)
    for i in range(a.shape[1]):
        for j in range(b.shape[1]):
            out += w[i] * w[j] * np.bitwise_count(a[:, i, None] & b[None, :, j])
    return out


def nearest(planes: np.ndarray, norms: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid; of equally near ones the first."""
    cluster, distance = np.empty(len(planes), np.int32), np.empty(len(planes), np.int64)
    centre_planes, centre_norms, step = pack(centres, planes.shape[1]), (centres * centres).sum(1), max(1, PAIRS // len(centres))
    for k in range(0, len(planes), step):
        s = slice(k, k + step)
        far = norms[s, None] - 2 * dots(planes[s], centre_planes) + centre_norms
        cluster[s] = far.argmin(1)
        distance[s] = far.min(1)
    return cluster, distance


def plane_table(table: DataFrame, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame, int]:
    """(planes, counted, bits). planes: vec_id, planes, norm of every vector that counts; counted: vec_id and its integers."""
    kept = table.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("x")).where((F.size("x") == WIDTH) & vectors.finite(F.col("x")))
    bits = (vectors.largest(kept, "x", scale) + 1).bit_length() + 1
    counted = kept.select("vec_id", vectors.integers(F.col("x"), scale).alias("v"))
    schema = pa.schema([("vec_id", pa.int64()), ("planes", pa.list_(pa.int64())), ("norm", pa.int64())])
    small_batches(table.sparkSession)

    def run(batches):
        for batch in batches:
            if n := batch.num_rows:
                v = vectors.matrix(batch.column(1), n)
                words = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bits, pa.int32()), pa.array(pack(v, bits).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), words, pa.array((v * v).sum(1))], schema=schema)

    return keep(counted.mapInArrow(run, "vec_id long, planes array<long>, norm long"), "bit-planes"), counted, bits


def start(counted: DataFrame, k: int, seed: int) -> np.ndarray:
    """k rows at most, the same for any order and partitioning of the table."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return np.array([r.v for r in counted.orderBy(key, "v").limit(k).collect()], np.int64).reshape(-1, WIDTH)


def cluster(table: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(assigned, centroids). assigned: vec_id, cluster, distance for every vector that counts."""
    planes, counted, _ = plane_table(table, scale, vec_id, vector)
    centres = start(counted, k, seed)
    read = lambda batch: (vectors.matrix(batch.column(1), batch.num_rows).view(np.uint64), batch.column(2).to_numpy())

    def sums(at: np.ndarray):
        def kernel(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            words, norms = read(batch)
            return nearest(words, norms, at)[0], unpack(words)

        return kernel

    for _ in range(rounds if len(centres) else 0):
        centres = vectors.moved(centres, *vectors.group_sums(planes, sums(centres), len(centres), WIDTH))
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                found, distance = nearest(*read(batch), centres)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array(distance)], schema=schema)

    return planes.mapInArrow(assign, "vec_id long, cluster int, distance long"), centres


def cluster_report(table: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    assigned, centres = cluster(table, k, rounds, scale, seed)
    assigned = keep(assigned, "clusters")
    held = {r.cluster: r.inertia for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # k rows
    rows = [(c, s, sum(held.values()), vectors.digest(centres[c])) for c, s in sorted(held.items())]
    facts = table.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
