"""Lists of files that a conversation read, wrote and edited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEME = r"(?i)[a-z][a-z0-9+.-]*://"
LIMIT = 20


def is_path(name: Column) -> Column:
    """Not an address with a scheme."""
    return ~name.rlike(SCHEME)


def modes(ops: DataFrame) -> DataFrame:
    """(conv_id, path, mode) of operations (conv_id, path, op); op: read, written or edited."""
    seen = ops.where(is_path(F.col("path"))).groupBy("conv_id", "path").agg(F.bool_or(F.col("op") == "read").alias("r"), F.bool_or(F.col("op") != "read").alias("w"))
    return seen.select("conv_id", "path", F.when(F.col("r") & F.col("w"), "read+write").when(F.col("w"), "written").otherwise("read").alias("mode"))


def listing(ops: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(conv_id, n_files, files): the first ``limit`` paths in order, and a note of how many more there are."""
    lines = F.transform("all", lambda x: F.concat(x["path"], F.lit(" ("), x["mode"], F.lit(")")))
    gathered = modes(ops).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("path", "mode"))).alias("all"))
    note = F.concat(F.lit("\n[…"), (F.size("all") - limit).cast("string"), F.lit(" more files elided…]"))
    shown = F.concat(F.array_join(F.slice(lines, 1, limit), "\n"), F.when(F.size("all") > limit, note).otherwise(""))
    return gathered.select("conv_id", F.size("all").cast("long").alias("n_files"), shown.alias("files"))
