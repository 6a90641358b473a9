"""Vector code compression with exact products.

Vectors are cut into equal parts; each part position has a codebook, and a vector's code names the nearest entry of every
part. Distances are |v|**2 - 2 v.c + |c|**2 with integers. The dot products come from float64 matrix products that are exact:
integers are broken into limbs, so narrow that a product of two limbs, summed over a part, stays below 2**53; each pair of
limbs is one BLAS call for all parts, and the results are shifted and added in int64. The first of equally near entries
counts. Limbs are as many as the largest component needs, two at least.

The integers of all vectors are written once; a round reads them, assigns every part and adds up by (part, entry) inside
tasks. The driver holds the codebooks only.

Defined results: rows without a vector or with null or non-finite components are dropped. The length of the vector
with the smallest id decides (a multiple of the number of parts, not 0; equal ids: by components); vectors of another length keep
their row, with a null code and error, and teach nothing. Codebooks start from the smallest ids (a null id is the smallest);
fewer vectors than entries give as many entries. Rows that repeat count each. An empty table gives an empty result. Labels that
are null are one group; the sum over a label without any error is null. Other columns are ignored. Components that reach
2**26 after scaling raise an error, as distances would not fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import broadcast_if, keep, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Up to so many labels (some 20 bytes each) their sums are broadcast; beyond, they are joined by a shuffle.
BROADCAST_LABELS = 500_000


def limb_plan(most: int, length: int) -> tuple[int, int]:
    """(limbs, bits of a limb) for integers of at most ``most`` in size, in parts of ``length``."""
    widest = (53 - max(length - 1, 1).bit_length()) // 2
    bits = most.bit_length() + 1
    limbs = max(2, -(-bits // widest))
    return limbs, -(-bits // limbs)


def limbs_of(v: np.ndarray, limbs: int, bits: int) -> list[np.ndarray]:
    """Float limbs, lowest first; all but the last are in [0, 2**bits), the last keeps the sign."""
    low = [(v >> (bits * k)) & ((1 << bits) - 1) for k in range(limbs - 1)]
    return [x.astype(np.float64) for x in [*low, v >> (bits * (limbs - 1))]]


def products(v: np.ndarray, c: np.ndarray, most: int) -> np.ndarray:
    """Exact dot products: v (parts, n, length), c (parts, entries, length) -> (parts, n, entries)."""
    limbs, bits = limb_plan(most, v.shape[2])
    right = limbs_of(c.transpose(0, 2, 1), limbs, bits)
    out = np.zeros((v.shape[0], v.shape[1], c.shape[1]), np.int64)
    for i, a in enumerate(limbs_of(v, limbs, bits)):
        for j, b in enumerate(right):
            out += (a @ b).astype(np.int64) << (bits * (i + j))
    return out


def nearest(v: np.ndarray, books: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """v (n, parts, length), books (parts, entries, length) -> entry and squared distance of every part, each (n, parts)."""
    by_part = v.transpose(1, 0, 2)
    far = (by_part * by_part).sum(2)[:, :, None] - 2 * products(by_part, books, most) + (books * books).sum(2)[:, None, :]
    return far.argmin(2).T, far.min(2).T


def train(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray, int]:
    """(kept, codebooks, most). kept: vec_id, label, v (null for a vector of another length)."""
    small_batches(table.sparkSession)
    found = table.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("x")).where(vectors.finite(F.col("x")))
    whole = found.where((F.size("x") > 0) & (F.size("x") % parts == 0))
    first = whole.select("vec_id", vectors.integers(F.col("x"), scale).alias("v")).orderBy("vec_id", "v").limit(1).collect()
    width = len(first[0].v) if first else 0
    whole = found.where(F.size("x") == width)
    most = vectors.largest(whole, "x", scale) + 1
    kept = keep(found.withColumn("v", F.when((F.size("x") == width) & (F.size("x") > 0), vectors.integers(F.col("x"), scale))).drop("x"), "vector-integers")
    heads = kept.where("v is not null").orderBy("vec_id", "v").limit(entries).collect() if width else []
    books = np.array([r.v for r in heads], np.int64).reshape(len(heads), parts, -1 if heads else 0).transpose(1, 0, 2)
    length = width // parts

    def sums(at: np.ndarray):
        def kernel(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            v = vectors.matrix(batch.column(0), batch.num_rows).reshape(batch.num_rows, parts, length)
            return (nearest(v, at, most)[0] + np.arange(parts) * at.shape[1]).ravel(), v.reshape(-1, length)

        return kernel

    for _ in range(rounds if heads else 0):
        n, total = vectors.group_sums(kept.where("v is not null").select("v"), sums(books), parts * books.shape[1], length)
        books = vectors.moved(books.reshape(-1, length), n, total).reshape(books.shape)
    return kept, books, most


def encode(kept: DataFrame, books: np.ndarray, most: int) -> DataFrame:
    """vec_id, label, code, error."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("code", pa.string()), ("error", pa.int64())])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            code, error = np.full(batch.num_rows, None, object), np.zeros(batch.num_rows, np.int64)
            there = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            if there.any():
                v = vectors.matrix(batch.column(2).drop_null(), there.sum()).reshape(there.sum(), len(books), -1)
                entry, far = nearest(v, books, most)
                code[there] = [bytes(e).hex() for e in entry.astype(np.uint8)]
                error[there] = far.sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int64()), pa.array(code, pa.string()), pa.array(error, mask=~there)], schema=schema)

    return kept.select("vec_id", "label", "v").mapInArrow(run, "vec_id long, label long, code string, error long")


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The integers that a code stands for."""
    return np.concatenate([books[p, e] for p, e in enumerate(bytes.fromhex(code))])


def code_report(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    kept, books, most = train(table, parts, entries, rounds, scale)
    coded = keep(encode(kept, books, most), "vector-codes")
    sums = keep(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label"), "label-errors")
    met = coded.join(broadcast_if(sums, sums.count(), BROADCAST_LABELS), F.col("label").eqNullSafe(F.col("__label")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(vectors.digest(books)).alias("codebooks_sha256"))
