"""Sharding by a Feistel permutation with cycle walking.

Rows get global numbers 0 .. n - 1 in the order of their ids, and a keyed permutation of 0 .. n - 1 puts row r at place
p(r): shard p mod shards, slot p div shards. So shard counts differ by one at most, slots have no gaps, and both follow from
(r, n, seed) alone; ``row_at`` gives the row of a shard and slot. The permutation is a Feistel network of ROUNDS rounds over the
least even number of bits that holds n; a place beyond n is permuted again until it falls inside (cycle walking), which
takes fewer than four steps on average.

Numbering is one range sort of narrow rows, written to the shared folder with each row's place inside its task; the tasks' counts
(one number a task) give the offsets. Texts are not moved by ``placements``; ``write_shards`` moves each twice.

Defined results: a null text has no bytes, so its size is 1; an empty text too. A null id comes first. Rows that repeat an
id are numbered by size, checksum and hash of their text; rows equal in all of these can't be told apart, and a last key spreads
them over tasks. Very long texts are only measured. An empty table gives an empty result. Extra columns are ignored by
``placements`` and carried by ``write_shards``.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

SHARDS, SEED, ROUNDS = 8, 20240601, 6
MASK = np.uint64((1 << 32) - 1)
#: Two odd multipliers of a 32-bit finaliser.
MULTIPLIERS = (0x85EBCA6B, 0xC2B2AE35)


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    return [int.from_bytes(sha256(f"{seed}:{k}".encode()).digest()[:4], "big") for k in range(rounds)]


def half_bits(n: int) -> int:
    """Bits of a half of the network for n rows."""
    if n > 1 << 62:
        raise ValueError("more than 2**62 rows")
    return max(1, -(-(n - 1).bit_length() // 2)) if n > 1 else 1


def _scramble(x: np.ndarray, key: int, half: int) -> np.ndarray:
    x = (x + np.uint64(key)) & MASK
    for m, shift in zip(MULTIPLIERS, (16, 15), strict=True):
        x = ((x ^ (x >> np.uint64(shift))) * np.uint64(m)) & MASK
    return (x ^ (x >> np.uint64(13))) & np.uint64((1 << half) - 1)


def _network(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    left, right = x >> np.uint64(half), x & np.uint64((1 << half) - 1)
    for key in keys:
        left, right = right, left ^ _scramble(right, key, half)
    return (left << np.uint64(half)) | right


def _network_back(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    left, right = x >> np.uint64(half), x & np.uint64((1 << half) - 1)
    for key in reversed(keys):
        left, right = right ^ _scramble(left, key, half), left
    return (left << np.uint64(half)) | right


def _walk(x: np.ndarray, n: int, step) -> np.ndarray:
    """step until the number is below n; the cycle that a number lies on leads back below n at its own start at the latest."""
    x = step(np.asarray(x, np.uint64))
    while len(out := np.flatnonzero(x >= np.uint64(n))):
        x[out] = step(x[out])
    return x.astype(np.int64)


def permute(rows: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The place of each row number below n."""
    half, keys = half_bits(n), round_keys(seed)
    return _walk(rows, n, lambda x: _network(x, half, keys))


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """The row number that lies in a slot of a shard."""
    half, keys = half_bits(n), round_keys(seed)
    return _walk(np.asarray(slot) * shards + np.asarray(shard), n, lambda x: _network_back(x, half, keys))


def body(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def numbered(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """(rows with row_number in the order given, how many)."""
    spark = rows.sparkSession
    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("own")
    keyed = rows.select(own, *[c.alias(f"o{k}") for k, c in enumerate(order)]).withColumn("tie", F.monotonically_increasing_id())
    keys = [*[f"o{k}" for k in range(len(order))], "tie"]
    ranged = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("own", F.monotonically_increasing_id().alias("at"))
    laid = keep(ranged, "numbered")
    task = F.shiftright("at", 33).alias("task")
    counts = sorted(laid.groupBy(task).count().collect())  # a number for each task
    starts = [0, *accumulate(r[1] for r in counts)]
    offsets = spark.createDataFrame([(r[0], s - (r[0] << 33)) for r, s in zip(counts, starts, strict=False)], "task long, offset long")
    met = laid.withColumn("task", task).join(F.broadcast(offsets), "task")
    return met.select("own.*", (F.col("at") + F.col("offset")).alias("row_number")), starts[-1]


def placed(rows: DataFrame, n: int, shards: int, seed: int) -> DataFrame:
    """Adds place, shard and slot to numbered rows."""

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(np.uint64), n, seed))

    found = rows.withColumn("place", place("row_number"))
    return found.withColumn("shard", (F.col("place") % shards).cast("int")).withColumn("slot", F.expr(f"place div {shards}"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, text_hash."""
    return docs.select("doc_id", (F.octet_length(body()) + 1).cast("long").alias("size"), F.crc32(body()).alias("text_crc32"), F.xxhash64(body()).alias("text_hash"))


def placements(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null), row_number for every row."""
    rows, n = numbered(measured(docs), [F.col(c) for c in ("doc_id", "size", "text_crc32", "text_hash")])
    found = placed(rows, n, shards, seed)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """The rows of docs as Parquet under path/shard=K, in slot order from file to file; a shard is cut into as many files as
    its size asks for. Documents lie in column ``document``."""
    size, crc, text_hash = (F.octet_length(body()) + 1).cast("long"), F.crc32(body()), F.xxhash64(body())
    rows, n = numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), F.col("doc_id").alias("id"), size.alias("size"), crc.alias("crc"), text_hash.alias("hash")), [F.col(c) for c in ("id", "size", "crc", "hash")])
    out = placed(rows, n, shards, seed).select("shard", "slot", "document")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
