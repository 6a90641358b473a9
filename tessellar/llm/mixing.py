"""Mixing sources to target weights by temperature (native: DataFrame functions only).

A source with share p of all tokens gets the weight p**a / sum(p**a). The exponent a in [0, 1] is bisected: the largest
one whose weights reach the target entropy (a fraction of the log of the source count), or, where that would repeat a
source more often than the limit allows, the smallest one within the limit. Weights times the token budget are the
source quotas. A source is dealt in whole epochs and a last, partial one. In the partial epoch its documents lie in
blocks by a seeded hash; blocks are taken in order up to the quota, and the block at its edge is cut in key order. No
sort spans a source: the running sum over blocks has at most MAX_BLOCKS rows, and one block holds some n / MAX_BLOCKS.

A document weighs its words plus one (its end), so empty texts are dealt too. A null source is the source "(none)".
Rows that repeat a doc_id are dealt together and tie in order; very long texts weigh their words. Empty input gives an
empty result. Extra columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_CLASS, broadcast_if, keep

TARGET_ENTROPY = 0.95
MAX_REPEATS = 4.0
STEPS = 20
SEED = 20240601
MAX_BLOCKS = 4096
BLOCK_DOCS = 64
#: Up to so many sources (some 100 bytes each) the plan is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 50_000


def source_of() -> Column:
    return F.coalesce(F.col("source"), F.lit("(none)"))


def draw_key(epoch: Column) -> Column:
    """60 seeded bits for a document in an epoch."""
    text = F.concat_ws(":", F.lit(str(SEED)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def solve_exponent(sizes: DataFrame, budget: int, total: int, n_sources: int, target: float, repeats: float) -> float:
    """Bisection, one aggregate over the sources a step. Low exponents are flatter: more entropy, more repetition."""

    def flatter_than_needed(a: float) -> bool:
        p = F.col("tokens") / F.lit(float(total))
        z, e, least = sizes.agg(F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p)), F.min(p)).first()
        import math

        entropy = math.log(z) - a * e / z
        return entropy >= target * math.log(n_sources) or least ** (a - 1) * budget / (total * z) >= repeats

    if n_sources < 2 or flatter_than_needed(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (mid, high) if flatter_than_needed(mid) else (low, mid)
    return round((low + high) / 2, 6)


def mixing_plan(docs: DataFrame, target: float = TARGET_ENTROPY, repeats: float = MAX_REPEATS, budget: int | None = None) -> tuple[DataFrame, int, DataFrame]:
    """(plan, its row count, slim documents). plan, by source: tokens, weight, quota, whole (epochs), n_blocks, edge
    (block) and edge_key: in epoch ``whole``, documents of earlier blocks and of the edge block up to that key go in."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD_CLASS)) + 1
    slim = keep(docs.select("doc_id", source_of().alias("source"), words.cast("long").alias("tokens")), "mix-slim")
    sizes = keep(slim.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")), "mix-sizes")
    n_sources, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    one_file = lambda df: df.coalesce(1) if n_sources <= BROADCAST_SOURCES else df
    sizes = keep(one_file(sizes), "mix-sizes")  # read again in each step
    budget = total if budget is None else budget
    a = solve_exponent(sizes, budget, total, n_sources, target, repeats) if total else 1.0
    power = F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(a))
    z = sizes.agg(F.sum(power)).first()[0] or 1.0
    plan = sizes.withColumn("weight", power / F.lit(z)).withColumn("quota", F.floor(F.col("weight") * F.lit(float(budget)) + 0.5))
    plan = plan.withColumn("whole", F.expr("quota div tokens")).withColumn("rest", F.expr("quota % tokens"))
    plan = plan.withColumn("n_blocks", F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("n_docs") / BLOCK_DOCS)))
    part = slim.join(broadcast_if(plan.drop("tokens"), n_sources, BROADCAST_SOURCES), "source").withColumn("key", draw_key(F.col("whole")))
    part = part.withColumn("block", F.col("key") % F.col("n_blocks"))
    blocks = part.groupBy("source", "block", "rest").agg(F.sum("tokens").alias("held"))
    filled = blocks.withColumn("before", F.sum("held").over(Window.partitionBy("source").orderBy("block")) - F.col("held"))
    edges = filled.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("held") > F.col("rest")))
    edges = keep(edges.select("source", F.col("block").alias("edge"), (F.col("rest") - F.col("before")).alias("room")), "mix-edges")
    inside = part.join(broadcast_if(edges, n_sources, BROADCAST_SOURCES), "source").where(F.col("block") == F.col("edge"))
    inside = inside.withColumn("used", F.sum("tokens").over(Window.partitionBy("source").orderBy("key")))  # peers share a doc_id
    cut = inside.where(F.col("used") <= F.col("room")).groupBy("source").agg(F.max("key").alias("edge_key"))
    plan = plan.join(edges.drop("room"), "source", "left").join(cut, "source", "left")
    return keep(one_file(plan.withColumn("edge_key", F.coalesce("edge_key", F.lit(-1)))), "mix-plan"), n_sources, slim


def draw(rows: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """rows (doc_id, source, any more) repeated as the plan says, with epoch, block and order_key. An epoch of a source is its
    documents by block, and within a block by order_key: another permutation in every epoch."""
    inner = plan.select(F.col("source").alias("__source"), F.col("whole").alias("__whole"), F.col("n_blocks").alias("__blocks"), F.col("edge").alias("__edge"), F.col("edge_key").alias("__edge_key"))
    met = rows.join(broadcast_if(inner, n_sources, BROADCAST_SOURCES), source_of() == F.col("__source"))
    key = draw_key(F.col("__whole"))
    block = key % F.col("__blocks")
    extra = F.when((block < F.col("__edge")) | ((block == F.col("__edge")) & (key <= F.col("__edge_key"))), 1).otherwise(0)
    copies = (F.col("__whole") + extra).cast("int")
    met = met.withColumn("epoch", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))))
    met = met.withColumn("order_key", draw_key(F.col("epoch")))
    return met.withColumn("block", F.col("order_key") % F.col("__blocks")).drop("__source", "__whole", "__blocks", "__edge", "__edge_key")


def mix_sources(docs: DataFrame, target: float = TARGET_ENTROPY, repeats: float = MAX_REPEATS, budget: int | None = None) -> DataFrame:
    """doc_id, source, tokens, epoch, block, order_key: one row for each time that a document is dealt."""
    plan, n, slim = mixing_plan(docs, target, repeats, budget)
    return draw(slim, plan, n)


def mixed_documents(docs: DataFrame, target: float = TARGET_ENTROPY, repeats: float = MAX_REPEATS, budget: int | None = None) -> DataFrame:
    """The rows of docs, repeated or left out as the mixture says, with their own columns only."""
    plan, n, _ = mixing_plan(docs, target, repeats, budget)
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("__own")
    return draw(docs.select("doc_id", "source", own), plan, n).select("__own.*")
