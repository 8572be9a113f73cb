"""Frames as files named by their content.

A frame's file is ``<sha256>.png`` in the folder of its archive below a folder that all executors share, given as a path
or a URI of any file system that Arrow knows. Writing is idempotent: the name decides the content, so a task
that runs again writes the same bytes, and a file gets its name only when it is whole. Reading hashes again and gives
nothing for a file that is missing or does not match its name.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from foliant.functions.batches import BLOCK
from foliant.operators import archive
from foliant.session import importable


def located(root: str) -> tuple[FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    system, base = FileSystem.from_uri(root)
    return system, base.rstrip("/")


def write(frames: DataFrame, root: str) -> DataFrame:
    """Write ``frames`` (frames_dir, png) below ``root``; returns (frames_dir, file, bytes), one row a file. Equal frames of a folder are one file.

    The result is lazy: the files are there once it has been computed.
    """
    importable(frames.sparkSession)
    named = frames.where(archive.is_dir_name(F.col("frames_dir")) & F.col("png").isNotNull()).select("frames_dir", archive.file_name(F.col("png")).alias("file"), "png").dropDuplicates(["frames_dir", "file"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = located(root)
        for batch in batches:
            sizes = []
            for folder, name, png in zip(*(batch[c].to_pylist() for c in ("frames_dir", "file", "png"))):
                system.create_dir(f"{base}/{folder}", recursive=True)
                part = f"{base}/{folder}/.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(png)
                system.move(part, f"{base}/{folder}/{name}")
                sizes.append(len(png))
            yield pa.RecordBatch.from_arrays([batch["frames_dir"], batch["file"], pa.array(sizes, pa.int64())], names=["frames_dir", "file", "bytes"])

    return named.mapInArrow(save, "frames_dir string, file string, bytes long")


def externalized(archives: DataFrame) -> DataFrame:
    """Archives whose frames refer to files instead of holding data."""
    moved = lambda f: f.withField("file", F.coalesce(archive.file_name(F.unbase64(f["data"])), f["file"])).withField("data", F.lit(""))
    return archives.withColumn("frames", F.transform("frames", lambda f: F.when(F.coalesce(f["data"], F.lit("")) != "", moved(f)).otherwise(f)))


def read(spark: SparkSession, root: str) -> DataFrame:
    """(frames_dir, file, content) of the files whose bytes hash to their name, in folders of archives.

    Spark lists all files in the driver and leaves out empty ones; ``resolved`` opens those that rows name.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(root)
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -2).alias("frames_dir"), F.element_at(parts, -1).alias("file"), "content")
    return named.where(archive.is_dir_name(F.col("frames_dir")) & archive.is_file_name(F.col("file")) & (archive.file_name(F.col("content")) == F.col("file")))


def content(system: FileSystem, base: str, folder: str | None, name: str) -> bytes | None:
    """The bytes of a frame's file; None where it is missing or does not match its name."""
    try:
        with system.open_input_stream(f"{base}/{folder}/{name}") as f:
            png = f.read()
    except FileNotFoundError:
        return None
    return png if hashlib.sha256(png).hexdigest() + ".png" == name else None


def present(frames: DataFrame, root: str) -> DataFrame:
    """The rows of ``frames`` (frames_dir, file and other columns) whose file is there and matches its name.

    Each file is opened by the task that holds its row, so that neither folders are listed nor other files read.
    """
    importable(frames.sparkSession)

    @F.arrow_udf("boolean")
    def there(folders: pa.Array, names: pa.Array) -> pa.Array:
        system, base = located(root)
        return pa.array([content(system, base, folder, name) is not None for folder, name in zip(folders.to_pylist(), names.to_pylist())], pa.bool_())

    named = frames.where(archive.is_dir_name(F.col("frames_dir")) & archive.is_file_name(F.col("file")))
    return named.where(there.asNondeterministic()("frames_dir", "file"))  # so that the names are checked before


def resolved(frames: DataFrame, root: str) -> DataFrame:
    """Frames (conv_id, frames_dir, pos, file, data) with the data of their files where they hold none; null data: unavailable.

    Each file is opened by the task that holds its row, so that the driver lists no folders and contents are not shuffled.
    """
    importable(frames.sparkSession)
    filed = (F.coalesce("data", F.lit("")) == "") & archive.is_dir_name(F.col("frames_dir")) & archive.is_file_name(F.col("file"))
    asked, columns = frames.withColumn("asked", F.when(filed, F.col("file"))), frames.columns

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = located(root)
        for batch in batches:
            rows, pngs, size = batch.select(columns), [], 0
            for i, (folder, name) in enumerate(zip(batch["frames_dir"].to_pylist(), batch["asked"].to_pylist()), 1):
                pngs.append(None if name is None else content(system, base, folder, name))
                size += len(pngs[-1] or b"")
                if size >= BLOCK or i == len(rows):
                    part = rows.slice(i - len(pngs), len(pngs))
                    yield part.append_column("content", pa.array(pngs, pa.binary()))
                    pngs, size = [], 0

    found = asked.mapInArrow(opened, StructType([*frames.schema.fields, StructField("content", BinaryType())]))
    data = F.regexp_replace(F.base64("content"), r"[\r\n]", "")
    return found.withColumn("data", F.when(F.coalesce("data", F.lit("")) != "", F.col("data")).otherwise(data)).drop("content")


def slots_udf(root: str, most: int, estimate: int):
    """(frames, frames_dir) -> slots. Only files of frames that fit by the estimate are opened, newest first."""

    @F.arrow_udf(f"array<{archive.SLOT}>")
    def walk(frames: pa.Array, folders: pa.Array) -> pa.Array:
        system, base = located(root)

        def shown(folder: str | None, name: str) -> str | None:
            png = content(system, base, folder, name)
            return None if png is None else base64.b64encode(png).decode()

        rows = []
        for some, folder in zip(frames.to_pylist(), folders.to_pylist()):
            slots, used = [], 0
            for frame in reversed(some or []):
                data = frame["data"] or ""
                cost = len(data) or estimate
                if used + cost > most:
                    slots.append({"state": archive.OMITTED, "bytes": cost, "data": None})
                    continue
                data = data or (shown(folder, frame["file"]) if frame["file"] else None)
                used += len(data or "")
                slots.append({"state": archive.KEPT if data else archive.UNAVAILABLE, "bytes": len(data or ""), "data": data})
            rows.append(None if some is None else slots[::-1])
        return pa.array(rows, pa.list_(pa.struct([("state", pa.string()), ("bytes", pa.int64()), ("data", pa.string())])))

    return walk


def with_slots(archives: DataFrame, root: str, most: int, estimate: int = archive.FRAME_ESTIMATE) -> DataFrame:
    """``archives`` (frames_dir and frames with data or a file) with ``slots``: what is shown under ``most`` bytes of base64.

    Frames are admitted newest first. One that refers to a file is admitted by the estimate, opened only then, and
    counted with its actual size; a file that is missing or does not match its name makes the frame unavailable. A
    frame that does not fit is omitted, and older ones may still fit. A folder or file whose name is not one of an
    archive is unavailable. Archives without files stay inside the JVM.
    """
    importable(archives.sparkSession)
    named = F.transform("frames", lambda f: F.struct(f["data"].alias("data"), F.when(archive.is_file_name(f["file"]), f["file"]).alias("file")))
    filed = F.exists("frames", lambda f: (F.coalesce(f["data"], F.lit("")) == "") & archive.is_file_name(f["file"])) & archive.is_dir_name(F.col("frames_dir"))
    walk = slots_udf(root, most, estimate).asNondeterministic()  # so that the optimizer does not copy the call into every use of the slots
    staged = archives.withColumn("named", F.when(filed, named))
    return staged.withColumn("slots", F.when(filed, walk("named", "frames_dir")).otherwise(archive.inline_slots(F.col("frames"), most, estimate))).drop("named")


def remove_superseded(root: str, persisted: DataFrame) -> list[str]:
    """Remove the folders below ``root`` that no archive of ``persisted`` (frames_dir) refers to; returns their names.

    Call it once the new archives are written and verified. Only folders with an archive's folder name go.
    """
    system, base = located(root)
    here = [(p.base_name,) for p in system.get_file_info(FileSelector(base)) if p.type == FileType.Directory]
    folders = persisted.sparkSession.createDataFrame(here, "frames_dir string").where(archive.is_dir_name(F.col("frames_dir")))
    gone = [r[0] for r in folders.join(persisted.select("frames_dir"), "frames_dir", "left_anti").orderBy("frames_dir").collect()]
    for name in gone:
        system.delete_dir(f"{base}/{name}")
    return gone
