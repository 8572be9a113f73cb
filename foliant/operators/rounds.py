"""A round of archiving from requests to the index: layout, painting, the store of frames, signatures, entries.

Requests say how their pages look; each look is one plan over its own requests, and pages of all looks are painted
together, a page a row, so one long conversation is painted by many tasks. Layouts and images are written to the shared
folder once; the names of the files go back to their archive as short strings, images themselves never do.

What a round does it does in the order that a failure leaves harmless: files first, then the index entry that refers to
them, then the removal of folders that no entry refers to any more. A round that runs again under its number writes
the same files and replaces its entries.

Defined cases: a request with an unknown look fails the round; an archive without content has no entry; a conversation
without a request keeps the entry it has; no requests make a batch without entries. ``conv_id`` is unique in a round.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import dim_stopwords
from foliant.operators import archive, layout, raster, writing
from foliant.session import settled, spread
from foliant.sources import frame_store
from foliant.streaming.index import ArchiveIndex

PREVIOUS = "struct<text:string,text_head:string,text_tail:string,truncated_chars:bigint>"


@dataclass(frozen=True)
class Look:
    """A name, the sheets of the two tiers, and whether function words are grey."""

    name: str
    high: raster.Sheet
    low: raster.Sheet
    dim: bool = False


def folder(conv_id: Column, batch: int) -> Column:
    """A folder for the frames of a conversation's round; two that share one by chance share files named by content."""
    return F.concat(F.lit(archive.DIR_PREFIX), F.pmod(F.xxhash64(conv_id, F.lit(batch)), F.lit(10**16)).cast("string"))


def laid_out(requests: DataFrame, looks: list[Look], batch: int, most: int, **options) -> DataFrame:
    """``requests`` (writing.compact's columns and look) as archives that still lack images, one plan a look."""
    known = F.col("look").isin([x.name for x in looks])
    checked = requests.withColumn("look", F.when(known, F.col("look")).otherwise(F.raise_error(F.concat(F.lit("unknown look: "), F.coalesce("look", F.lit("null"))))))
    checked = settled(spread(checked, "conv_id"))  # so that an unknown look fails here and filters read it from a table
    made = [
        writing.compact(checked.where(F.col("look") == x.name).drop("look"), high=(x.high.cols, x.high.rows), low=(x.low.cols, x.low.rows), most=most, shape=x.name, **options).withColumn("look", F.lit(x.name))
        for x in looks
    ]
    return settled(reduce(DataFrame.unionByName, made).withColumn("frames_dir", F.when(F.size("frames") > 0, folder(F.col("conv_id"), batch))))


def images(made: DataFrame, looks: list[Look], glyphs: raster.Glyphs) -> DataFrame:
    """(conv_id, frames_dir, pos, file, png, height, chars) of the pages of laid out archives."""
    pages = made.select("conv_id", "frames_dir", "look", F.size("pages").alias("n"), F.posexplode("pages").alias("pos", "page"))
    text = F.col("page.text")
    dimmed = F.when(F.col("look").isin([x.name for x in looks if x.dim]), dim_stopwords(text)).otherwise(text)
    shown = pages.select("conv_id", "frames_dir", "pos", F.concat_ws("/", "look", "page.tier").alias("sheet"), dimmed.alias("text"), layout.banner(F.col("pos") + 1, F.col("n")).alias("banner"))
    sheets = {f"{x.name}/{tier}": sheet for x in looks for tier, sheet in (("high", x.high), ("low", x.low))}
    return raster.painted(spread(shown, "conv_id", "pos"), glyphs, sheets).drop("sheet").withColumn("file", archive.file_name(F.col("png")))


def with_files(made: DataFrame, painted: DataFrame) -> DataFrame:
    """Archives whose frames name the files of their images and count what these print."""
    named = painted.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "file", "chars"))).alias("files_of"))  # at most the page budget
    filled = F.transform("frames", lambda f, i: f.withField("file", F.get("files_of", i)["file"]).withField("chars", F.get("files_of", i)["chars"]))
    return made.join(named, "conv_id", "left").withColumn("frames", filled).drop("files_of")


def archive_round(requests: DataFrame, looks: list[Look], glyphs: raster.Glyphs, index: ArchiveIndex, root: str, *, batch: int, ts: int, most: int, **options) -> None:
    """Archive ``requests`` (conv_id, first_kept, text, summary, files, look), each behind the trusted archive that ``index`` has of its conversation.

    Frames go below ``root``, entries of time ``ts`` into batch ``batch`` of the index, which signs and checks
    with the same key; ``options`` are those of ``writing.compact``.
    """
    asked = requests.withColumn("previous", F.lit(None).cast(PREVIOUS))
    if index.started():  # a round that runs again stands behind the batches before its own
        kept = index.live(before=batch).select("conv_id", F.struct("text", "text_head", "text_tail", "truncated_chars").alias("previous"))
        asked = requests.join(kept, "conv_id", "left")
    made = laid_out(asked, looks, batch, most, **options)
    painted = settled(images(made, looks, glyphs))
    frame_store.save(painted, root)
    entries = writing.signed(with_files(made, painted), index.key)
    index.upsert(entries.withColumns({"ts": F.lit(ts).cast("long"), "seq": F.lit(batch).cast("long")}), batch)
    index.collect_garbage(root)
