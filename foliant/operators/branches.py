"""Branches of a conversation: entries that know their parent, and what a reader at a leaf stands on.

A conversation is a tree of entries (conv_id, id, parent_id). A leaf's branch is the way up to the root. What a new archive
continues is the first compaction on that way, trusted or not: an untrusted one is not passed over, since older ones
miss what it holds.

Ways up are followed by pointer doubling: in each round every entry takes over the pointer of the entry it points to, so
a way of n entries takes log2(n) joins, however deep the tree is. Each round is written, which cuts lineage.

Defined cases: a parent that is not among the entries ends the way; entries on a cycle find nothing; ids are unique in
a conversation; a leaf that is itself a compaction finds itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators import archive
from foliant.session import settled


def first_above(entries: DataFrame, stop: Column) -> DataFrame:
    """(conv_id, id, found): for each entry the nearest one at or above it that ``stop`` holds for; null where there is none."""
    at = settled(entries.select("conv_id", "id", F.when(stop, F.col("id")).otherwise(F.col("parent_id")).alias("to"), F.coalesce(stop | F.col("parent_id").isNull(), F.lit(False)).alias("done")))
    rounds = max(1, at.count()).bit_length()  # no way is longer than all entries: what is open then runs in a circle
    for _ in range(rounds):
        if at.where("not done").isEmpty():
            break
        ahead = at.select("conv_id", F.col("id").alias("to"), F.col("to").alias("far"), F.col("done").alias("far_done"))
        moved = at.where("not done").drop("done").join(ahead, ["conv_id", "to"], "left")
        at = settled(at.where("done").unionByName(moved.select("conv_id", "id", F.col("far").alias("to"), F.coalesce("far_done", F.lit(True)).alias("done"))))
    return at.select("conv_id", "id", F.when(F.col("done"), F.col("to")).alias("found"))


def previous_archives(entries: DataFrame, leaves: DataFrame, key: bytes | None, verify: bool = True) -> DataFrame:
    """(conv_id, leaf, id, trusted and the archive's columns) of the first compaction above each leaf (conv_id, leaf).

    ``entries``: conv_id, id, parent_id, type and an archive's columns, null but for compactions. A leaf without a
    compaction above has null everywhere; an untrusted archive keeps only ``id`` and ``frames_dir``, which say what it
    supersedes.
    """
    found = leaves.join(first_above(entries, F.col("type") == "compaction").withColumnRenamed("id", "leaf"), ["conv_id", "leaf"], "left")
    valid = archive.validate(entries.where("type = 'compaction'").drop("parent_id", "type"))
    ok = F.lit(True) if not verify else archive.verified(valid.drop("id"), key) if key else F.lit(False)
    judged = valid.withColumn("trusted", ok)
    hidden = [c for c in valid.columns if c not in ("conv_id", "id", "frames_dir")]
    shown = judged.withColumns({c: F.when(F.col("trusted"), F.col(c)) for c in hidden})
    return found.withColumnRenamed("found", "id").join(shown, ["conv_id", "id"], "left")
