"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Rows of a small table that may be sent to every task.
BROADCAST_ROWS = 200_000
#: Spark's setting by which a query that has ended leaves no shuffle files behind; else they lie there until Java collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on a single machine, as in tests, one of the session's own where that is not set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes within remove their shuffle files as soon as they have ended. Each write is planned anew, so none needs another's files."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, name: str, share: int = 0) -> DataFrame:
    """Write as Parquet and read back. A frame that several later steps read is computed once, plans stay small, a lost
    executor costs the running step only, and the disk holds the written rows instead of the shuffles that made them.

    With a ``share`` the files hold so many rows at most, and each is a partition when read: by a session of its own, whose
    reader packs no files together. The frame should then not leave the query."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("maxRecordsPerFile", share).parquet(path)
    if share:
        spark = spark.newSession()
        spark.conf.set("spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file, in whatever store the session reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A staged or otherwise cheap side of a join: broadcast where it has ``limit`` rows at most, else hashed by shuffle."""
    return df.hint("broadcast" if df.limit(limit + 1).count() <= limit else "shuffle_hash")
