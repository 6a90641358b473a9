"""Files that arrive as a stream, admitted once by path and content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import admitted


def arrivals(spark: SparkSession, root: str) -> DataFrame:
    """A stream of path, content, hash over Parquet files of (path, content) that appear in root."""
    files = spark.readStream.schema("path string, content string").parquet(root)
    return files.where(admitted(F.col("path"))).select("path", "content", F.sha2("content", 256).alias("hash"))


def misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose (path, hash) the cache does not have: what is left to parse."""
    return files.join(cache.select("path", "hash"), ["path", "hash"], "left_anti")


def fold_into(stream: DataFrame, cache: str, checkpoint: str):
    """Append each arrival's first occurrence to the cache table; a restarted query repeats no finished batch."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        fresh = rows.dropDuplicates(["path", "hash"])
        spark = rows.sparkSession
        if spark.catalog.tableExists(cache):
            fresh = misses(fresh, spark.table(cache))
        fresh.write.mode("append").saveAsTable(cache)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
