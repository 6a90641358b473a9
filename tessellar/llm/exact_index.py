"""Exact dedup by an extendible-hash index on shared files (native: DataFrame functions only).

The key of a text is a 64-bit hash of its normalised form. The directory maps the leading bits of a key to a bucket. It
starts as one bucket and doubles while some bucket holds more than ``capacity`` keys: an overfull bucket of local depth d
parts into its two children of depth d + 1, the others keep their depth and are pointed at by several cells. LEVEL bits
are doubled in one pass; a cell that is overfull after them gets a directory of its own over the next LEVEL bits, down to
all 64, so no depth is out of reach. The capacity grows with the keys (at least CAPACITY), so that the first level, which
is broadcast, has at most 2**LEVEL cells and nearly always suffices.

Each bucket is a contiguous key range and has one owner task. Rows are routed to the owner by the directory: a key that
only one row has comes as an entry at once, its text stays where it is; the others come with their bytes. The owner
compares bytes within a key and chains what differs: one entry for each distinct text. Keys of many rows (HOT) are first
combined by bytes before they are routed, so a text that a third of all rows hold reaches its owner as one row. The index
is written by bucket and key, and documents look their entry up there.

Defined results: null text equals empty text and a text of blanks only is one space; rows that repeat a doc_id are
separate members, and the keep row is the smallest doc_id (nulls last); of rows with that same id all are kept; empty
input gives an empty result; very long texts are only compared where a key repeats; extra columns are ignored by the
index and carried by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANK_CLASS, broadcast_if, keep

#: Bits of one level of the directory: at most 65,536 cells, some 40 bytes each when broadcast.
LEVEL = 16
#: Distinct keys that a bucket holds before it splits, at least; and a bucket's share of all keys that may raise it.
CAPACITY, BUCKETS = 4096, 1 << 14
#: A key of more rows than this is combined before it is routed.
HOT = 256
#: Up to so many repeated keys (8 bytes each) are broadcast to find their texts; beyond, texts are joined by a shuffle.
BROADCAST_KEYS = 500_000


def normalised(text: Column) -> Column:
    """Each run of blanks as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK_CLASS + "+", " ")


def cell_of(key: Column, bits: int = LEVEL) -> Column:
    """The leading bits of a 64-bit key, as 0 .. 2**bits - 1 (a signed number for all 64)."""
    return F.shiftrightunsigned(key, 64 - bits) if bits < 64 else key


def doubled(cells: DataFrame, bits: int, capacity: int) -> DataFrame:
    """cells: cell (of ``bits`` bits), n. Adds depth, where the cell's bucket comes to rest, and held, the keys in it.

    One doubling splits every overfull bucket, so a cell rests at the least depth whose prefix holds no more than
    capacity keys; all LEVEL depths are counted in one pass. The counts are at most twice as many as the cells of a level.
    """
    prefix = f"shiftrightunsigned(cell, {bits} - depth)"
    at = cells.withColumn("depth", F.explode(F.sequence(F.lit(bits - LEVEL), F.lit(bits)))).withColumn("prefix", F.expr(prefix))
    filled = at.groupBy("depth", "prefix").agg(F.sum("n").alias("held"))
    filled = filled if bits > LEVEL else F.broadcast(filled)
    rest = at.join(filled, ["depth", "prefix"]).where((F.col("held") <= capacity) | (F.col("depth") == bits))
    least = rest.groupBy("cell").agg(F.min(F.struct("depth", "held")).alias("rest"))
    return least.select("cell", "rest.depth", "rest.held")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> list[DataFrame]:
    """For each level: cell, depth, bucket (the least key of the bucket's range, as a signed number), final (does the cell
    end here, or does the next level divide it further?)."""
    levels: list[DataFrame] = []
    rest = keys.select("key")
    for bits in range(LEVEL, 65, LEVEL):
        cells = rest.groupBy(cell_of(F.col("key"), bits).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        found = doubled(cells, bits, capacity).withColumn("final", (F.col("held") <= capacity) | F.lit(bits == 64))
        start = f"shiftleft(shiftrightunsigned(cell, {bits} - depth), 64 - depth)"
        bucket = F.expr(f"if(depth = 0, 0L, {start})")
        levels.append(keep(found.select("cell", "depth", bucket.alias("bucket"), "final"), "exact-directory"))
        over = levels[-1].where("not final").select(F.col("cell").alias("__cell"))
        n = over.count()
        if not n:
            break
        rest = rest.join(broadcast_if(over, n, 1 << LEVEL), cell_of(F.col("key"), bits) == F.col("__cell"), "left_semi")
    return levels


def routed(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """rows with depth and bucket of their key."""
    for k, level in enumerate(levels):
        bits = (k + 1) * LEVEL
        own = level.where("final").select(F.col("cell").alias("__cell"), F.col("depth").alias(f"__depth{k}"), F.col("bucket").alias(f"__bucket{k}"))
        own = F.broadcast(own) if k == 0 else broadcast_if(own, own.count(), 1 << LEVEL)
        rows = rows.join(own, cell_of(F.col("key"), bits) == F.col("__cell"), "left").drop("__cell")
    found = lambda name: F.coalesce(*[F.col(f"__{name}{k}") for k in range(len(levels))]).alias(name)
    return rows.select(*[c for c in rows.columns if not c.startswith("__")], found("depth"), found("bucket"))


def build_index(docs: DataFrame, capacity: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(digests, index). digests: doc_id, key, sha for every row. index: bucket, depth, key, chain (0, 1, .. among the
    distinct byte strings of one key), sha, keep_id, group_size; files by bucket, sorted by key."""
    text = docs.select("doc_id", normalised(F.col("text")).alias("body")).withColumn("key", F.xxhash64("body"))
    digests = keep(text.select("doc_id", "key", F.unhex(F.sha2("body", 256)).alias("sha")), "exact-digests")
    known = digests.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("keep_id"), F.min("sha").alias("sha"))
    known = keep(known, "exact-keys")
    n_keys, n_repeated = known.agg(F.count(F.lit(1)), F.count_if(F.col("rows") > 1)).first()
    levels = directory(known, max(CAPACITY, n_keys // BUCKETS) if capacity is None else capacity)
    single = known.where("rows = 1").select("key", "sha", "keep_id", F.lit(1).cast("long").alias("group_size"))
    repeated = known.where("rows > 1").select(F.col("key").alias("__key"), (F.col("rows") > HOT).alias("hot"))
    held = text.join(broadcast_if(repeated, n_repeated, BROADCAST_KEYS), F.col("key") == F.col("__key"))
    held = routed(held.select("doc_id", "key", "body", "hot"), levels).withColumn("n", F.lit(1).cast("long"))
    group = ["bucket", "depth", "key", "body"]
    hot = held.where("hot").groupBy(*group).agg(F.min("doc_id").alias("doc_id"), F.sum("n").alias("n"))
    owned = held.where("not hot").drop("hot").unionByName(hot).repartition("bucket")
    chains = owned.groupBy(*group).agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))  # bytes, in the owner's task
    chains = chains.withColumn("sha", F.unhex(F.sha2("body", 256))).drop("body")
    link = Window.partitionBy("bucket", "key").orderBy(F.col("keep_id").asc_nulls_last(), "sha")
    chains = chains.withColumn("chain", F.row_number().over(link) - 1)
    lone = routed(single, levels).withColumn("chain", F.lit(0))
    columns = ["bucket", "depth", "key", "chain", "sha", "keep_id", "group_size"]
    index = lone.select(columns).unionByName(chains.select(columns)).repartition("bucket").sortWithinPartitions("bucket", "key", "chain")
    return digests, keep(index, "exact-index")


def exact_dedup(docs: DataFrame, capacity: int | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    digests, index = build_index(docs, capacity)
    found = digests.join(index.select("key", "sha", "keep_id", "group_size"), ["key", "sha"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, capacity: int | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts those of the smallest doc_id (rows that repeat
    both that id and the text cannot be told apart and stay together)."""
    held = exact_dedup(docs, capacity).where("kept").select(F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_sha")).distinct()
    sha = F.sha2(normalised(F.col("text")), 256)
    return docs.join(held, docs["doc_id"].eqNullSafe(F.col("__kept_id")) & (sha == F.col("__kept_sha")), "left_semi")
