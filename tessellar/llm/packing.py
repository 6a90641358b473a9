"""Packing along a space-filling curve.

Each document's token ids are hashed into a vector of BINS counts, which a fixed random projection brings down to
DIMENSIONS numbers. Their Hilbert key orders the documents so that similar ones are neighbours. The encoded table is
range-sorted by (key, doc_id) and every range is packed by one task along the curve: documents are laid end to end and
cut every ``length`` tokens. What is left at the end of a range is cut at powers of two, which need no padding. A range
is bounded by the sort, however many documents share a key: equal keys part by doc_id and by a hash of the ids.

Null text is empty, and an empty document is its end token. Rows that repeat are packed each, with pieces of their own;
rows equal in doc_id and ids are interchangeable. A very long text is many pieces of neighbouring sequences. Empty input
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import keep, map_texts, small_batches

LENGTH = 2048
END = 1
BINS, DIMENSIONS, BITS = 64, 4, 8
#: Encoded bytes (2 a token) that one range task packs, roughly.
RANGE_BYTES = 32 << 20


def directions(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BINS, DIMENSIONS)) / np.sqrt(BINS)


def grid(vectors: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Square roots of the bin counts, scaled to length 1, less their mean, projected, and put on 2**BITS steps."""
    x = np.sqrt(vectors)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    y = (x - x.mean(axis=1, keepdims=True)) @ to
    return np.clip((y * 1.5 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of rows of coordinates below 2**bits (bits * dimensions at most 63). From the highest bit down,
    each plane of bits swaps or reflects the lower planes; the Gray code of what results, read plane by plane, is the
    place on the curve."""
    x = points.T.copy()
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(len(x)):
            on = (x[i] >> b) & 1 == 1
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ swap)
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            place = (place << 1) | ((row >> b) & 1)
    return place


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, place (Hilbert key), n_tokens, ids (little-endian, 2 bytes an id where the vocabulary allows, else 4)."""
    to = directions()

    def run(cols: dict) -> dict:
        bpe = tokens.load(path)
        kind = np.uint16 if max(bpe.slow.get_vocab_size(True), END) < 1 << 16 else np.uint32
        ids = [np.append(bpe.ids(x or ""), np.uint32(END)) for x in cols["text"]]
        bins = np.array([np.bincount((x * np.uint32(2654435761)) >> np.uint32(26), minlength=BINS) for x in ids], float)
        return {"doc_id": cols["doc_id"], "place": hilbert(grid(bins, to)), "n_tokens": [len(x) for x in ids], "width": np.full(len(ids), np.dtype(kind).itemsize, np.int32), "ids": [x.astype(kind).tobytes() for x in ids]}

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, place long, n_tokens long, width int, ids binary")


def last_cuts(n: int) -> list[int]:
    """n as a sum of powers of two, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, place."""
    spark = docs.sparkSession
    small_batches(spark)
    coded = keep(encode(docs, path), "pack-ids")
    size = coded.agg(F.sum(F.col("n_tokens") * F.col("width"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    order = ["place", "doc_id", F.xxhash64("ids")]
    laid = coded.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("task", F.spark_partition_id().cast("long"))
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "place")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_pieces: list[list] = []  # pieces of the sequence that is not full yet, with their ids
        filled = made = 0
        task = 0

        def rows(pieces: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pieces], pa.int64()) for i in range(8)], schema=schema)

        for batch in batches:
            done: list[list] = []
            cols = {n: batch.column(n) for n in batch.schema.names}
            for k in range(batch.num_rows):
                task = cols["task"][k].as_py()
                ids = np.frombuffer(cols["ids"][k].as_buffer(), np.uint16 if cols["width"][k].as_py() == 2 else np.uint32).astype("<u4")
                doc_id, place, at = cols["doc_id"][k].as_py(), cols["place"][k].as_py(), 0
                while at < len(ids):
                    n = min(len(ids) - at, length - filled)
                    open_pieces.append([doc_id, at, n, zlib.crc32(ids[at : at + n]), len(ids), (task << 40) + made, filled, place, ids[at : at + n]])
                    at, filled = at + n, filled + n
                    if filled == length:
                        done += open_pieces
                        open_pieces, filled, made = [], 0, made + 1
            if done:
                yield rows(done)
        final: list[list] = []
        for cut in last_cuts(filled):  # at most one sequence is left: part it at powers of two
            used = 0
            while used < cut:
                doc_id, start, n, _, doc_tokens, _, _, place, ids = open_pieces.pop(0)
                take = min(n, cut - used)
                final.append([doc_id, start, take, zlib.crc32(ids[:take]), doc_tokens, (task << 40) + made, used, place])
                if take < n:
                    open_pieces.insert(0, [doc_id, start + take, n - take, 0, doc_tokens, 0, 0, place, ids[take:]])
                used += take
            made += 1
        if final:
            yield rows(final)

    return laid.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, place long")
