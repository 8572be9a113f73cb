"""The index of archives: which archive a summary of a conversation stands for, kept up to date by a stream.

Entries (conv_id, ts, seq and an archive's columns) come in micro-batches. Each batch is validated, its signatures are
checked, and it is written as one folder named by its number, so a batch that a restarted stream delivers again
replaces what it wrote before and nothing counts twice. Readers see one entry for each conversation and time: of
trusted entries the one of the last batch, there the one with the largest ``seq``.

A newer archive holds all that the older ones of its conversation held, so their folders of frames are garbage as soon
as it is persisted. Garbage is what no live entry refers to; it goes after the batch is committed, never before.

Defined cases: an entry without conversation, time or content is no entry; a null ``seq`` comes before all others; an
untrusted entry neither replaces another nor keeps a folder alive, and is counted; a folder whose name is not one of an
archive is never removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow.fs import FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import archive
from foliant.session import exists, importable, remove, spread
from foliant.sources.frames import located


class ArchiveIndex:
    def __init__(self, spark: SparkSession, root: str, key: bytes | None, verify: bool = True):
        self.spark, self.root, self.key, self.verify = spark, root.rstrip("/"), key, verify

    def upsert(self, entries: DataFrame, batch: int) -> None:
        """Write a batch; the function that ``foreachBatch`` calls."""
        valid = archive.validate(entries.where("conv_id is not null and ts is not null"))
        if not self.verify:
            ok: Column = F.lit(True)
        else:
            ok = archive.verified(valid.drop("ts", "seq"), self.key) if self.key else F.lit(False)
        valid.withColumn("trusted", ok).write.mode("overwrite").parquet(f"{self.root}/batch={batch}")

    def follow(self, entries: DataFrame, checkpoint: str, after: Callable[[int], None] = lambda batch: None):
        """Follow a stream of entries up to what it holds now; ``after`` runs behind each committed batch."""

        def commit(batch: DataFrame, number: int) -> None:
            self.upsert(batch, number)
            after(number)

        return entries.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def written(self) -> DataFrame:
        """All valid entries of all batches, with the number of their ``batch``."""
        return self.spark.read.option("basePath", self.root).parquet(self.root).withColumn("batch", F.col("batch").cast("long"))

    def started(self) -> bool:
        """Whether there is a first batch."""
        return exists(self.spark, self.root)

    def entries(self, before: int | None = None) -> DataFrame:
        """The trusted entries, one for each conversation and time; those of batches ``before`` a number only, if given."""
        rows = self.written().where("trusted")
        rows = rows if before is None else rows.where(F.col("batch") < before)
        last = rows.groupBy("conv_id", "ts").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("conv_id", "ts", "trusted")]), F.struct("batch", "seq")).alias("e"))
        return last.select("conv_id", "ts", "e.*")

    def live(self, before: int | None = None) -> DataFrame:
        """The newest entry of each conversation: the only one whose frames are read again."""
        return archive.latest(self.entries(before))

    def rejected(self) -> DataFrame:
        """(conv_id, rejected): how many entries were not trusted."""
        return self.written().groupBy("conv_id").agg(F.count_if(~F.col("trusted")).alias("rejected"))

    def superseded(self) -> DataFrame:
        """(frames_dir) of trusted entries that no live entry refers to."""
        mine = self.written().where("trusted and frames_dir is not null").select("frames_dir").distinct()
        return mine.join(self.live().select("frames_dir"), "frames_dir", "left_anti")

    def collect_garbage(self, frames: str) -> int:
        """Remove the superseded folders below ``frames``, each by the task that holds its name; returns how many there were."""
        importable(self.spark)

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, base = located(frames)
            for batch in batches:
                gone = 0
                for name in batch["frames_dir"].to_pylist():
                    if system.get_file_info(f"{base}/{name}").type == FileType.Directory:
                        system.delete_dir(f"{base}/{name}")
                        gone += 1
                yield pa.RecordBatch.from_arrays([pa.array([gone], pa.int64())], names=["gone"])

        names = self.superseded().where(archive.is_dir_name(F.col("frames_dir")))
        return spread(names, "frames_dir").mapInArrow(drop, "gone long").agg(F.coalesce(F.sum("gone"), F.lit(0))).first()[0]

    def merge_batches(self, upto: int) -> None:
        """Rewrite the batches up to a number as that batch, so that readers list few folders: superseded and older versions go."""
        merged = f"{self.root}-merging-{upto}"
        older = self.written().where(F.col("batch") <= upto)
        entries = ArchiveIndex.entries(self).where(F.col("batch") <= upto).withColumn("trusted", F.lit(True))
        refused = older.where(~F.col("trusted"))
        entries.unionByName(refused).drop("batch").write.mode("overwrite").parquet(merged)
        numbers = [r[0] for r in older.select("batch").distinct().collect()]
        self.spark.read.parquet(merged).write.mode("overwrite").parquet(f"{self.root}/batch={upto}")
        for number in numbers:
            if number != upto:
                remove(self.spark, f"{self.root}/batch={number}")
        remove(self.spark, merged)
