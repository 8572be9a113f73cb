"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The folder that holds the package.
HOME = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package from where the driver has it.

    On a cluster the package is installed on the executors or sent with ``--py-files``; there this
    only adds a path that does not exist.
    """
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if HOME not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([HOME, *filter(None, paths)])
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the cluster's shared folder, in local mode without one below a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="foliant-")
    return f"{base.removeprefix('file://').rstrip('/')}/{name}-{uuid.uuid4().hex}"


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


def shared(spark: SparkSession, name: str) -> str:
    """Like ``scratch``, as a path that Spark's readers and writers take (with its scheme)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ""
    return scratch(spark, name) if "://" not in base or base.startswith("file://") else f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and survives lost executors."""
    path, schema = shared(df.sparkSession, "settled"), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out to at least four tasks a core, by ``keys`` or in turn: for rows of few bytes and much work, which Spark would pack into few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)
