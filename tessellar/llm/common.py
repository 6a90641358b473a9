"""What the operators share: the documents reader, the shared work folder, Arrow kernels and word rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import keep

__all__ = ["BLANKS", "BLANK_CLASS", "WORD_CLASS", "broadcast_if", "crc_bucket", "documents", "fold", "keep", "map_texts", "mix", "small_batches", "words_of"]

#: The ASCII blanks that part words, as a string and as a Java / RE2 character class.
BLANKS = " \t\n\r\x0b\x0c"
BLANK_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Arrow batches of bounded rows and bytes, so that a batch of long texts fits a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def broadcast_if(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """df with a broadcast hint when its counted rows are within the limit; else a plain (shuffled) join side."""
    return F.broadcast(df) if rows <= limit else df


def map_texts(df: DataFrame, kernel: Callable[[dict], dict], schema: T.StructType | str) -> DataFrame:
    """mapInArrow over whole rows. kernel: columns as Python lists (or numpy arrays) -> output columns."""
    target = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = kernel({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, target)


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8 bytes; bytes.split() parts at exactly the six ASCII blanks."""
    return text.encode().split() if text else []


def fold(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else."""
    return text.encode().lower() if text else b""


#: Odd multipliers of the 64-bit mixing steps.
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over an array."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def crc_bucket(column: str, n: int):
    """crc32 of an integer column as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
