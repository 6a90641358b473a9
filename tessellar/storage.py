"""The folder that driver and executors share, and tables kept there to end a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Begins the names of the files by which writers claim versions.
CLAIM = "_claim-"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, the context's own checkpoint folder. Only a local session, as in tests, gets
    a new folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def tables_dir(spark: SparkSession) -> str:
    """This application's own tables."""
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete this application's tables, once no result that was made from them is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _numbered(spark: SparkSession, path: str, start: str) -> list[tuple[int, str]]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    return sorted((int(n[len(start) :]), n) for n in names if n.startswith(start) and n[len(start) :].isdigit())


def versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(version, folder) of everything that was put in place under path, oldest first."""
    return _numbered(spark, path, "v")


def next_version(spark: SparkSession, path: str) -> int:
    """One after all versions, and after all that were claimed by writers that did not come to an end."""
    return max((n for start in ("v", CLAIM) for n, _ in _numbered(spark, path, start)), default=0) + 1


def put_version(df: DataFrame, path: str, version: int) -> None:
    """Write df as folder v<version> under path, which must not exist. It is written under another name; the version is claimed
    by creating a file, which only one writer can, and the rename into place comes last: readers see all or nothing."""
    spark = df.sparkSession
    made = spark._jvm.org.apache.hadoop.fs.Path
    files = made(path).getFileSystem(spark._jsc.hadoopConfiguration())
    draft = made(f"{path}/_draft-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(draft.toString())
    claim = made(f"{path}/{CLAIM}{version}")
    if not files.createNewFile(claim):
        files.delete(draft, True)
        raise VersionTaken(f"version {version} of {path} is taken by another writer")
    if not files.rename(draft, made(f"{path}/v{version}")):
        files.delete(claim, False)
        raise OSError(f"version {version} of {path} could not be put in place")


class VersionTaken(RuntimeError):
    """Another writer has put the same version in place."""


def publish(df: DataFrame, path: str, tries: int = 10) -> int:
    """Write df as the next version under path. What fails leaves the version before it in place; where another writer
    takes a version first, the next one is tried, so no version is lost or mixed."""
    kept = keep(df, "publish")
    for _ in range(tries):
        version = next_version(df.sparkSession, path)
        try:
            put_version(kept, path, version)
            return version
        except VersionTaken:
            continue
    raise VersionTaken(f"{tries} versions of {path} were taken by other writers")


def published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version, or the latest one."""
    found = [f for v, f in versions(spark, path) if version in (None, v)]
    if not found:
        raise ValueError(f"nothing is published at {path}")
    return spark.read.parquet(f"{path}/{found[-1]}")
