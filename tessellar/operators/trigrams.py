"""A posting table of trigrams beside a table of rows, for searches of any literal part in any case.

Rows are numbered in an order of their own and lie in blocks of consecutive numbers (one folder a block, BLOCKS at most). The
posting table says for every three characters of the folded text which rows have them, and is sorted by them. A search reads the
postings of its own trigrams only, intersects them, the rarest first, and then reads the blocks that candidates
lie in (a filter on the partitions); what is found is verified on the texts. Texts end with two marks, so that parts of one or
two characters are prefixes of trigrams. New rows come as blocks and postings of their own, removed ones as a list of
numbers.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import holds, like_literal
from ..storage import keep, tables_dir
from . import scans
from .traversal import union_all

#: Blocks of one build or update; what is broadcast to prune them is a number for each.
BLOCKS = 1024
ROWS_A_BLOCK = 4096
END = "\u0001\u0001"


def folded(text: Column) -> Column:
    """ASCII letters in lower case, nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text: Column) -> Column:
    """Distinct trigrams of a text and its end marks; none for a null."""
    marked = F.concat(folded(text), F.lit(END))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text)), lambda k: F.substr(marked, k, F.lit(3))))


@dataclass(frozen=True)
class TrigramIndex:
    """rows: the columns of the table, __n and __block (a partition). postings: gram, __n. gone: __n. columns: those searched."""

    rows: list[str]
    postings: list[str]
    gone: list[DataFrame]
    columns: list[str]
    schema: object
    last: int

    def read(self, spark: SparkSession) -> DataFrame:
        return union_all([spark.read.schema(self.schema).parquet(p) for p in self.rows])


def _written(rows: DataFrame, columns: list[str], order: list[str], last: int) -> tuple[str, str, object, int]:
    spark = rows.sparkSession
    numbered = keep(scans.numbered(rows, order, "__n").withColumn("__n", F.col("__n") + last), "gram-rows")
    n = numbered.count()
    width = max(ROWS_A_BLOCK, -(-n // BLOCKS))
    path = f"{tables_dir(spark)}/grams-{uuid.uuid4().hex}"
    placed = numbered.withColumn("__block", F.expr(f"__n div {width} + {last}"))
    placed.repartitionByRange("__n").write.partitionBy("__block").parquet(f"{path}/rows")
    found = [numbered.select("__n", F.explode(grams(F.col(c))).alias("gram")) for c in columns]
    posted = union_all(found).distinct().withColumn("__block", F.expr(f"__n div {width} + {last}"))
    posted.repartitionByRange("gram", "__n").sortWithinPartitions("gram", "__n").write.option("compression", "zstd").parquet(f"{path}/postings")
    return f"{path}/rows", f"{path}/postings", placed.schema, last + n


def build(rows: DataFrame, columns: list[str], order: list[str]) -> TrigramIndex:
    """order: columns that tell rows apart; rows that are neighbours in it share blocks."""
    at, postings, schema, last = _written(rows, columns, order, 0)
    return TrigramIndex([at], [postings], [], columns, schema, last)


def updated(index: TrigramIndex, removed: DataFrame, added: DataFrame, key: str, order: list[str]) -> TrigramIndex:
    """The index after a change of snapshots: rows whose key is in removed go, those of added come. Only they are read and
    written; of the rows that stay only the keys are."""
    spark = added.sparkSession
    left = _alive(index, index.read(spark).select(key, "__n")).join(removed.select(key), key, "left_semi")
    gone = keep(left.select("__n"), "gram-gone")
    at, postings, _, last = _written(added, index.columns, order, index.last)
    return replace(index, rows=[*index.rows, at], postings=[*index.postings, postings], gone=[*index.gone, gone], last=last)


def _alive(index: TrigramIndex, rows: DataFrame) -> DataFrame:
    return rows.join(union_all(index.gone), "__n", "left_anti") if index.gone else rows


def candidates(index: TrigramIndex, spark: SparkSession, part: str) -> DataFrame:
    """__n, __block of the rows that have every trigram of a part. One count finds the rarest; the others are intersected
    with it in turn of their size."""
    posted = union_all([spark.read.parquet(p) for p in index.postings])
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in part)
    if len(text) < 3:
        return posted.where(F.col("gram").startswith(text)).select("__n", "__block").distinct() if text else posted.select("__n", "__block").distinct()
    wanted = sorted({text[k : k + 3] for k in range(len(text) - 2)})
    sizes = dict.fromkeys(wanted, 0) | {r.gram: r["count"] for r in posted.where(F.col("gram").isin(wanted)).groupBy("gram").count().collect()}
    rarest, *others = sorted(wanted, key=lambda g: (sizes[g], g))
    found = posted.where(F.col("gram") == rarest).select("__n", "__block")
    for g in others:
        found = found.join(posted.where(F.col("gram") == g).select("__n"), "__n", "left_semi")
    return found


def search(index: TrigramIndex, spark: SparkSession, part: str) -> DataFrame:
    """The rows with a column that holds the part, in any case of ASCII letters. Candidates are written, then only their
    blocks are read; a null or empty text holds nothing but the empty part."""
    near = keep(candidates(index, spark, part), "gram-candidates")
    blocks = [r[0] for r in near.select("__block").distinct().collect()]  # BLOCKS a build at most
    like = F.lit(False)
    for c in index.columns:
        like = like | F.coalesce(holds(F.col(c), f"%{like_literal(part)}%"), F.lit(False))
    some = index.read(spark).where(F.col("__block").isin(blocks)).join(near.select("__n"), "__n", "left_semi")
    return _alive(index, some.where(like)).drop("__n", "__block")
