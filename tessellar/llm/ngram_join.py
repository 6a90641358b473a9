"""N-gram Jaccard join by token-combination prefixes.

A document is its set of distinct 5-word shingles, as 64-bit hashes. Two sets of Jaccard 0.8 or more share a token among
the first n - ceil(0.8 n) + 1 tokens of each, in any order that is common to both. The work goes in stages:

1. Sets of equal size and equal 128-bit fingerprints fall into one class; only class representatives go on.
2. Each representative shows a prefix in hash order that is a fifth longer than it needs. A token that more than FREQUENT
   of them show is frequent (passages that many documents share, or groups of copies) and goes behind all rare ones. The
   longer prefix has enough rare tokens for most documents; these are plain. The others are dense, and read whole.
3. Plain and dense documents are indexed by the single rare tokens of their prefixes. Lists of rare tokens are short,
   and all their pairs with a plain member are verified: first by sizes and a bound from the prefixes alone (what the
   common part of the order shows, plus all that may follow), then by the whole sets.
4. Dense documents are joined with each other in an order of their own, rare tokens first by their counts over dense
   documents. Frequent tokens are indexed as 2-combinations. They are parted into groups by hash, about one for three
   tokens that a set of that size needs, and combinations are formed within a group: a group of g prefix tokens that
   shares less than two with a similar set misses g - 1 of it, so the prefix is extended until single tokens and g - 1
   for each group add up to what is needed. Group counts follow size classes; a set is indexed in its own and the next
   class, so that sets of nearly equal size meet.
5. In lists of combinations every member is first held against the most central member. Verified links join components.
   Pairs of different components in short lists are verified as pairs; long lists are compared block by block inside
   tasks, which return links only.

Every link between classes rests on an intersection of whole sets. No partner is dropped: only pairs already in one
component are passed over.

Words are runs of other than the six ASCII blanks, A-Z lower-cased. Null or blank text: the empty set, linked with
nothing. Fewer than five words: the whole sequence is the one shingle. Rows are the vertices, so rows that repeat a
doc_id are compared each, and a component's id is its smallest doc_id (nulls last). A very long text is one set; blocks of
long lists are sized by tokens. Empty input gives an empty result; extra columns are ignored, and carried by
``one_of_each``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if, fold, keep, map_texts
from .components import components
from .shingles import run_hashes, word_hashes

WORDS = 5
PERCENT = 80
#: A token of more documents than this is frequent; lists up to this length are compared pair by pair.
FREQUENT = 32
#: Documents and tokens (8 bytes each) in a block of a long list, on average.
BLOCK, BLOCK_TOKENS = 1500, 2_000_000
#: A token with more than HOT rows in a share of 1 / SHARE of the documents is counted by partial sums.
HOT, SHARE = 32, 64
#: Up to so many wanted rows (at most 24 bytes each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 600_000


def token_set(text: str | None) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    hashes = word_hashes(fold(text).split())
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(run_hashes(hashes, min(WORDS, len(hashes))))


def prefix_length(n):
    """n - ceil(0.8 n) + 1, for integers or arrays."""
    return n - -(-PERCENT * n // 100) + 1


def shown_length(n: int) -> int:
    """How much of a set its first index shows."""
    need = prefix_length(n)
    return min(n, need + -(-need // 5) + 3)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers as signed ones in the same order."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def longs(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(np.concatenate([*arrays, np.empty(0, np.uint64)]))))


def describe(docs: DataFrame) -> DataFrame:
    """row (unique), doc_id, mark (hash of the text), n, two set fingerprints, shown (the first tokens in order)."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("row"))

    def run(cols: dict) -> dict:
        sets = [token_set(x) for x in cols["text"]]
        one = np.array([s.sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
        two = np.array([np.bitwise_xor.reduce(s * (s >> np.uint64(7) | np.uint64(1))) if len(s) else 0 for s in sets], np.uint64)
        return {"row": cols["row"], "doc_id": cols["doc_id"], "mark": cols["mark"], "n": [len(s) for s in sets], "k1": signed(one), "k2": signed(two), "shown": longs([s[: shown_length(len(s))] if len(s) else s for s in sets])}

    return map_texts(rows, run, "row long, doc_id long, mark long, n long, k1 long, k2 long, shown array<long>")


def among(df: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """df rows whose column is (or, left_anti, is not) among the kept one-column table ids."""
    return df.join(broadcast_if(ids.toDF(column), ids.count(), BROADCAST_ROWS), column, how)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """v, n, tokens of the wanted rows (row, doc_id, mark); a row of docs that repeats doc_id and text comes again."""
    one = wanted.groupBy("doc_id", "mark").agg(F.min("row").alias("v"))
    one = keep(one.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "v"), "jaccard-wanted")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    met = texts.join(broadcast_if(one, one.count(), BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")))

    def run(cols: dict) -> dict:
        sets = [token_set(x) for x in cols["text"]]
        return {"v": cols["v"], "n": [len(s) for s in sets], "tokens": longs(sets)}

    return map_texts(met.select("v", "text"), run, "v long, n long, tokens array<long>")


def near_sizes(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """pairs (a, b) with na and nb where the smaller set could make up the threshold of the larger one."""
    met = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    return met.where((100 * F.col("na") >= PERCENT * F.col("nb")) & (100 * F.col("nb") >= PERCENT * F.col("na")))


def with_arrays(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """pairs with the arrays (v, x) of both ends as xa and xb; b's array travels to a."""
    return pairs.join(arrays.toDF("b", "xb"), "b").join(arrays.toDF("a", "xa"), "a")


def possible(pairs: DataFrame, shown: DataFrame) -> DataFrame:
    """Pairs that the shown parts do not rule out. Up to the smaller of their last tokens both sets are known: they share
    c there, and beyond it at most what the shorter rest holds."""
    met = with_arrays(pairs, shown)
    met = met.withColumn("h", F.least(F.element_at("xa", -1), F.element_at("xb", -1))).withColumn("c", F.size(F.array_intersect("xa", "xb")))
    upto = lambda x: F.expr(f"size(filter({x}, t -> t <= h))")
    most = F.col("c") + F.least(F.col("na") - upto("xa"), F.col("nb") - upto("xb"))
    return met.where((100 + PERCENT) * most >= PERCENT * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, na, nb) whose whole sets reach the threshold."""
    met = with_arrays(pairs, sets.select("v", "tokens")).withColumn("c", F.size(F.array_intersect("xa", "xb")))
    return met.where(100 * F.col("c") >= PERCENT * (F.col("na") + F.col("nb") - F.col("c"))).select("a", "b")


def ordered(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) without direction or repetition."""
    return rows.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def token_lists(index: DataFrame) -> DataFrame:
    """index (v, token, any more) with df, the number of rows of the token, where that is more than one. Rows are shuffled once, by
    token, and counted where they come to lie. Tokens with more than HOT rows among the v of one hash in SHARE would fill a
    task: they are few, are counted by partial sums, and their rows stay where they are. The share only picks the way; every
    row is counted exactly on either."""
    some = index.where(F.pmod(F.xxhash64("v"), F.lit(SHARE)) == 0).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    hot = keep(some.where(F.col("n") > HOT).select("token"), "jaccard-hot")
    n = hot.count()
    cold = index.join(broadcast_if(hot, n, BROADCAST_ROWS), "token", "left_anti")
    cold = cold.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("df > 1")
    if not n:
        return cold
    counts = index.join(broadcast_if(hot, n, BROADCAST_ROWS), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    return cold.unionByName(index.join(broadcast_if(counts, n, BROADCAST_ROWS), "token"))


def dense_lists(tokens: DataFrame) -> DataFrame:
    """tokens: v, n, token of all dense documents. Lists (token, v): rare single tokens, and combinations of frequent
    ones within hash groups, of prefixes in rare-first order."""
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    known = tokens.join(counts, "token").withColumn("often", F.col("df") > FREQUENT)
    need = F.expr(f"n - ceil({PERCENT} * n / 100) + 1")
    rank = F.row_number().over(Window.partitionBy("v", "often").orderBy("token"))
    rare = F.count_if(~F.col("often")).over(Window.partitionBy("v"))
    known = keep(known.withColumn("need", need).withColumn("rank", rank).withColumn("rare", rare).where("if(often, rare < need, rank <= need)"), "jaccard-dense")
    single = known.where("not often").select("token", "v")
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)) + 1e-9)
    often = known.where("often").withColumn("level", F.explode(F.array(level, level + 1)))
    groups = F.greatest(F.lit(1), F.floor(F.pow(F.lit(1.25), F.col("level")) * (100 - PERCENT) / 200)).cast("long")
    often = often.withColumn("group", F.pmod(F.xxhash64("token"), groups))
    seen = F.row_number().over(Window.partitionBy("v", "level", "group").orderBy("token"))
    often = often.withColumn("gain", (seen > 1).cast("int"))
    before = F.sum("gain").over(Window.partitionBy("v", "level").orderBy("token")) - F.col("gain")
    held = often.withColumn("before", before).where(F.col("rare") + F.col("before") < F.col("need"))
    held = held.groupBy("v", "level", "group").agg(F.sort_array(F.collect_list("token")).alias("t")).where(F.size("t") > 1)
    pairs = held.select("v", "level", "t", F.posexplode("t").alias("i", "x"))
    pairs = pairs.select("v", "level", "x", F.explode(F.expr("slice(t, i + 2, greatest(size(t) - i - 1, 0))")).alias("y"))
    return single.unionByName(pairs.select(F.xxhash64("level", "x", "y").alias("token"), "v"))


def link_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between different components among the documents (v, c, tokens) of two blocks, no more than join them."""
    n = rows["tokens"].map(len).to_numpy()
    flat = np.concatenate([np.asarray(t, np.int64) for t in rows["tokens"]])
    owner = np.repeat(np.arange(len(rows)), n)
    _, term = np.unique(flat, return_inverse=True)
    order = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[order], np.arange(term.max() + 2))
    holders, at = owner[order], np.concatenate([[0], np.cumsum(n)])
    v, (_, comp) = rows["v"].to_numpy(), np.unique(rows["c"].to_numpy(), return_inverse=True)
    out = []
    for x in np.flatnonzero(comp != np.bincount(comp).argmax()):
        met = np.concatenate([holders[starts[t] : starts[t + 1]] for t in term[at[x] : at[x + 1]]])
        shared = np.bincount(met, minlength=len(rows))
        for y in np.flatnonzero((100 * shared >= PERCENT * (n[x] + n - shared)) & (comp != comp[x])):
            if comp[y] != comp[x]:
                out.append((v[x], v[y]))
                comp[comp == comp[y]] = comp[x]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def long_lists(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components within long lists (head, v, c). Lists of one head are one; its documents are
    dealt to blocks, by their number and their tokens, and each pair of blocks is a group of bounded size."""
    own = lists.select("head", "v", "c").distinct().join(sets.select("v", "n"), "v")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_TOKENS)).cast("int")
    sized = own.join(own.groupBy("head").agg(blocks.alias("blocks")), "head")
    dealt = sized.withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("head", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "v", "c")
    return dealt.join(sets.select("v", "tokens"), "v").groupBy("head", "i", "j").applyInPandas(link_blocks, "a long, b long")


def dense_links(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join all similar dense documents."""
    held = lists.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    lists = keep(lists.join(held, "token"), "jaccard-combined")
    central = lists.groupBy("v").agg(F.avg("held").alias("score"))
    heads = lists.join(central, "v").groupBy("token").agg(F.max_by("v", F.struct("score", -F.col("v"))).alias("head"))
    lists = keep(lists.join(heads, "token"), "jaccard-headed")
    sizes = sets.select("v", "n")
    stars = keep(verified(near_sizes(ordered(lists.select(F.col("head").alias("a"), F.col("v").alias("b"))), sizes), sets), "jaccard-stars")
    found = components(stars)
    placed = keep(lists.join(found, "v", "left").withColumn("c", F.coalesce("component", "v")).drop("component"), "jaccard-components")
    mixed = placed.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("token")
    placed = placed.join(mixed, "token")
    short = placed.where(F.col("held") <= FREQUENT)
    left, right = short.select("token", F.col("v").alias("a"), F.col("c").alias("ca")), short.select("token", F.col("v").alias("b"), F.col("c").alias("cb"))
    pairs = ordered(left.join(right, "token").where("ca < cb"))
    return stars.unionByName(verified(near_sizes(pairs, sizes), sets)).unionByName(long_lists(placed.where(F.col("held") > FREQUENT), sets))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    rows = keep(describe(docs), "jaccard-rows")
    classes = keep(rows.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("row").alias("v")), "jaccard-classes")
    reps = among(rows.where("n > 0").withColumnRenamed("row", "v"), classes.select("v"), "v")
    index = reps.select("v", F.posexplode("shown").alias("pos", "token"))
    lists = keep(token_lists(index), "jaccard-lists")
    small = reps.select("v", "doc_id", "mark", "n", F.size("shown").alias("m"), F.expr(f"int(n - ceil({PERCENT} * n / 100) + 1)").alias("need"))
    late = lists.where(F.col("df") > FREQUENT).groupBy("v").agg(F.sort_array(F.collect_list("pos")).alias("late"))
    cut = F.expr("aggregate(late, need - 1, (q, p) -> if(p <= q, q + 1, q))")  # place of the last token needed
    touched = keep(small.join(late, "v").withColumn("cut", cut).withColumn("dense", F.col("cut") >= F.col("m")), "jaccard-touched")
    dense = keep(touched.where("dense").select("v"), "jaccard-dense-rows")
    ends = small.select("v", "need").join(touched.select("v", "cut"), "v", "left").select("v", F.coalesce("cut", F.col("need") - 1).alias("cut"))
    plain = among(lists.where(F.col("df") <= FREQUENT), dense, "v", "left_anti").join(ends, "v").where("pos <= cut").select("token", "v")
    plain = keep(plain, "jaccard-plain")
    dense_sets = keep(sets_of(docs, touched.where("dense").withColumnRenamed("v", "row")).dropDuplicates(["v"]), "jaccard-dense-sets")
    tokens = dense_sets.where("n > 1").select("v", "n", F.explode("tokens").alias("token"))
    common = lists.where(F.col("df") > FREQUENT).select("token").distinct()
    first = F.row_number().over(Window.partitionBy("v").orderBy("token"))
    open_tokens = tokens.join(common, "token", "left_anti").withColumn("place", first).where(F.expr(f"place <= n - ceil({PERCENT} * n / 100) + 1"))
    other = plain.withColumnRenamed("v", "b")
    pairs = plain.withColumnRenamed("v", "a").join(other, "token").where("a < b").select("a", "b")
    pairs = ordered(pairs.unionByName(open_tokens.select("token", F.col("v").alias("a")).join(other, "token").select("a", "b")))
    near = keep(possible(near_sizes(pairs, small.select("v", "n")), reps.select("v", "shown")), "jaccard-near")
    ids = near.select(F.col("a").alias("v")).unionByName(near.select(F.col("b").alias("v"))).distinct()
    ids = ids.join(dense, "v", "left_anti")
    sets = keep(dense_sets.unionByName(sets_of(docs, small.join(ids, "v").withColumnRenamed("v", "row"))), "jaccard-sets")
    links = keep(verified(near, sets).unionByName(dense_links(dense_lists(tokens), dense_sets)), "jaccard-links")
    place = classes.join(components(links), "v", "left").select("k1", "k2", "n", F.coalesce("component", "v").alias("component"))
    placed = keep(rows.drop("shown", "mark").join(place, ["k1", "k2", "n"], "left").withColumn("component", F.coalesce("component", "row")), "jaccard-placed")
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is their component's id: one document of each group, with all its columns."""
    kept = jaccard_components(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("__kept")), "left_semi")
