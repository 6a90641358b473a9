"""Literal mentions of many texts in many texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a run that leads from a declared text to those that may hold it.
RUN = 4
#: Characters of the pieces that lead to texts where a declared text has too few words: the longest that fits it.
PIECES = [8, 3, 1]
#: Declared texts of so many bytes in all are broadcast; beyond, they are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def runs(words: Column) -> Column:
    """Distinct hashes of every run of RUN words: the words beside themselves, shifted, so that each is looked at once."""
    shifted = [F.slice(words, F.lit(k + 1), F.greatest(F.size(words), F.lit(1))) for k in range(RUN)]
    beside = F.arrays_zip(*shifted)
    whole = F.filter(beside, lambda x: x[str(RUN - 1)].isNotNull())
    return F.array_distinct(F.transform(whole, lambda x: F.xxhash64(*[x[str(k)] for k in range(RUN)])))


def pieces(text: Column, k: int) -> Column:
    """Distinct runs of k characters of a text."""
    last = F.length(text) - k + 1
    return F.array_distinct(F.transform(F.when(last > 0, F.sequence(F.lit(1), last)), lambda i: F.substr(text, i, F.lit(k))))


def literal(texts: DataFrame, declared: DataFrame, text: str, needle: str) -> DataFrame:
    """Rows of texts with the rows of declared whose needle they hold, anywhere and whole. A needle leads, by the hash of
    its first run of words but for its outermost ones (which may be part of longer words where it is mentioned), to the
    texts that have this run. Needles of fewer words lead there by their first characters (PIECES), but where all needles are
    few they are sent to the texts instead. An empty needle is no mention. All candidates are verified."""
    inner = F.slice(F.col("__words"), F.lit(2), F.greatest(F.size("__words") - 2, F.lit(0)))
    tagged = declared.withColumn("__words", words_of(F.col(needle))).withColumn("__inner", inner)
    first = F.xxhash64(*[F.get("__inner", F.lit(k)) for k in range(RUN)])
    tagged = tagged.withColumn("__run", F.when(F.size("__inner") >= RUN, first)).select(*declared.columns, "__run")
    long, short = tagged.where("__run is not null"), tagged.where(F.col("__run").isNull() & (F.col(needle) != "")).drop("__run")
    small = (declared.agg(F.sum(F.octet_length(needle))).first()[0] or 0) <= BROADCAST_BYTES
    out = [*texts.columns, *declared.columns]
    own = texts.withColumn("__words", words_of(F.col(text))).withColumn("__run", F.explode(runs(F.col("__words")))).drop("__words")
    found = own.join(F.broadcast(long) if small else long, "__run").where(F.col(text).contains(F.col(needle))).select(*out)
    if small:
        return found.unionByName(texts.join(F.broadcast(short), F.col(text).contains(F.col(needle))).select(*out))
    most = None
    for k in PIECES:
        size = F.length(needle)
        some = short.where((size >= k) & (size < most if most else F.lit(True))).withColumn("__piece", F.substring(needle, 1, k))
        near = texts.withColumn("__piece", F.explode(pieces(F.col(text), k)))
        found = found.unionByName(near.join(some, "__piece").where(F.col(text).contains(F.col(needle))).select(*out))
        most = k
    return found
