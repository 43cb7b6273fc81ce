"""The folder that all machines of the cluster share, and sessions whose tasks stay small."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode (tests) a folder of our own where that is unset, on a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = f"file://{tempfile.mkdtemp(prefix='shapeloom-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


# fixed values: what a task gets at most, in bytes of files and of shuffled rows; both are compressed, and terms take 10 to 50 times as much in memory
READ, DEALT, FILE_A_PART = 8 << 20, 4 << 20, 2 << 20


def fine(spark: SparkSession) -> SparkSession:
    """A copy of the session for graphs: the caller's settings, but smaller pieces in tasks.

    Spark deals out rows by their compressed size. Rows of terms repeat their namespaces and datatypes, so that 64 MB of them, the
    size that adaptive execution merges partitions to, are millions of rows and GBs in a task's sorts and hash tables.
    """
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for k, most in (("spark.sql.files.maxPartitionBytes", READ), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", DEALT)):
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(own.conf.get(k)) > most:
            own.conf.set(k, f"{most}b")
    return own


def fit(spark: SparkSession, table: DataFrame) -> None:
    """Shuffles of a session of `fine` get a partition at least for every 2 MB of a table's files."""
    files = int(table._jdf.queryExecution().analyzed().stats().sizeInBytes())
    if files // FILE_A_PART > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", files // FILE_A_PART)
