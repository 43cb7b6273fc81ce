"""Intermediate tables and files in the folder that all machines of the cluster share."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_scopes: list[list[str]] = []


@contextlib.contextmanager
def scope():
    """Collects the shared paths that are made inside, for `remove` once nothing reads them any more."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete shared paths, wherever they are stored."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def swept(spark: SparkSession):
    """What is executed inside has its shuffle files removed as soon as it ends; garbage collection comes an execution too late, as Spark holds on to the last one."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def query(f):
    """A query whose result is written to the shared folder, after which all its other tables there are removed."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scope() as made:
            out = f(spark, sf_dir)
        out = table(out, f.__name__)
        remove(spark, made)
        return out

    return run


def shared(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; in local mode (tests) a folder of our own where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = f"file://{tempfile.mkdtemp(prefix='shapeloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    for made in _scopes:
        made.append(path)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and lost executors cost nothing."""
    path = shared(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files(uri: str):
    """(file system, path) of a shared folder, as Arrow's file systems see it, on any executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def spread(listed: DataFrame) -> DataFrame:
    """A table of files, a task for each of them."""
    return listed.repartition(max(1, listed.count()))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["files", "query", "read", "remove", "scope", "shared", "spread", "swept", "table"]
