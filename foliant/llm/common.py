"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import importable

#: Stands for a null id where rows must be ordered: before every other id.
LOWEST_ID = -(2**63)
#: Whether Spark removes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The folder of each application that has no shared one.
_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared folder, or in local mode, where none is set, below a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="foliant-")
        base = _LOCAL[app]
    return f"{base.rstrip('/')}/foliant-{uuid.uuid4().hex}"


def _located(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists, in any file system that Spark knows."""
    system, found = _located(spark, path)
    return system.exists(found)


def remove(spark: SparkSession, path: str) -> None:
    system, found = _located(spark, path)
    system.delete(found, True)


def stash(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors.

    The shuffle files of the write go when it is done.
    """
    spark = importable(df.sparkSession)
    path, schema, before = path or shared_dir(spark), df.schema, spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def stashed(df: DataFrame) -> Iterator[DataFrame]:
    """A stash of ``df`` that goes with the end of the block; what is made of it must be written by then."""
    path = shared_dir(importable(df.sparkSession))
    try:
        yield stash(df, path)
    finally:
        remove(df.sparkSession, path)


def id_order(col: str | Column) -> Column:
    """The id as a number that is never null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(LOWEST_ID))


def doc_bucket(doc_id: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null ids take bucket -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n)), F.lit(-1))
