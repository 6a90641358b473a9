"""A Python data source over the blobs of one commit."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.predicates import admitted

BLOBS_A_PARTITION = 500
# Fixed value: larger blobs are not read.
MAX_BYTES = 32 << 20


def git(root: str, *args: str, given: bytes | None = None) -> bytes:
    return subprocess.run(["git", "--no-optional-locks", "-C", root, *args], check=True, capture_output=True, input=given).stdout


class RevisionReader(DataSourceReader):
    """The driver lists the tree below root once; each partition asks one child process for its blobs, and holds one of them
    at a time."""

    def __init__(self, root: str, revision: str):
        self.root = root
        self.commit = git(root, "rev-parse", "--verify", "--end-of-options", f"{revision}^{{commit}}").decode().strip()

    def partitions(self) -> list[InputPartition]:
        listed = []
        for entry in git(self.root, "ls-tree", "-rzl", self.commit).split(b"\0"):
            meta, _, path = entry.partition(b"\t")
            mode, kind, blob, size = (meta.split() + [b""] * 4)[:4]
            if kind == b"blob" and mode != b"120000" and int(size) <= MAX_BYTES:  # no links
                listed.append((blob.decode(), path))
        return [InputPartition(listed[i : i + BLOBS_A_PARTITION]) for i in range(0, len(listed), BLOBS_A_PARTITION)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, bytes]]:
        with subprocess.Popen(["git", "--no-optional-locks", "-C", self.root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as child:
            for blob, path in partition.value:
                child.stdin.write(f"{blob}\n".encode())
                child.stdin.flush()
                size = int(child.stdout.readline().split()[2])
                yield path.decode("utf-8", "surrogateescape"), child.stdout.read(size)
                child.stdout.read(1)
            child.stdin.close()


class RevisionSource(DataSource):
    """format("revision") with the options root and revision: path, content."""

    @classmethod
    def name(cls) -> str:
        return "revision"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return RevisionReader(self.options["root"], self.options.get("revision", "HEAD"))


def capture_revision(spark: SparkSession, root: str, revision: str = "HEAD") -> DataFrame:
    """path, content, hash of the admitted files of valid UTF-8 in a commit."""
    spark.dataSource.register(RevisionSource)
    blobs = spark.read.format("revision").option("root", root).option("revision", revision).load().where(admitted(F.col("path")))
    blobs = blobs.where(F.expr("is_valid_utf8(cast(content as string))"))
    return blobs.select("path", F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("hash"))
