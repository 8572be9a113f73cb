"""The read side: which archives are trusted, and what takes their place in the messages of a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import bounded_replay
from foliant.operators import archive, transcript
from foliant.operators.writing import source_text

SUMMARY = "summary"


def trusted(archives: DataFrame, key: bytes | None, verify: bool = True) -> DataFrame:
    """Valid archives that are signed with ``key``; with ``verify`` off all valid ones. Without a key none is trusted."""
    valid = archive.validate(archives)
    if not verify:
        return valid
    return valid.where(archive.verified(valid, key)) if key else valid.where(F.lit(False))


def status(archives: DataFrame, key: bytes | None, by: str, verify: bool = True) -> DataFrame:
    """Archives, frames, characters and dropped characters by ``by``, over the trusted ones, and how many valid ones were rejected."""
    valid = archive.validate(archives)
    ok = F.lit(not verify) if not verify or not key else archive.verified(valid.drop(by), key)
    judged = valid.withColumn("ok", ok)
    mine = lambda c: F.coalesce(F.sum(F.when(F.col("ok"), c)), F.lit(0)).cast("long")
    return judged.groupBy(by).agg(
        F.count_if("ok").alias("archives"), mine(F.size("frames")).alias("frames"), mine(F.col("total_chars")).alias("chars"), mine(F.col("truncated_chars")).alias("dropped"), F.count_if(~F.col("ok")).alias("rejected")
    )


def mode(enabled: Column, vision: Column, instructions: Column) -> Column:
    """How a request is served: by images, by text, or by the host's own way (switched off, or the user asked for a certain summary)."""
    own = ~F.coalesce(enabled, F.lit(True)) | (F.trim(F.coalesce(instructions, F.lit(""))) != "")
    return F.when(own, "default").when(F.coalesce(vision, F.lit(False)), "image").otherwise("text")


def latest_trusted(entries: DataFrame, key: bytes | None, verify: bool = True) -> DataFrame:
    """The newest entry of each conversation where it is trusted: an untrusted newest one hides the older ones."""
    return trusted(archive.latest(entries).drop("seq", "ts"), key, verify)


def rewrite(messages: DataFrame, archives: DataFrame, most: int) -> DataFrame:
    """(conv_id, ts, pos, type, text, data): the messages (conv_id, ts, role, text, vision) as blocks.

    Summaries whose time is that of an archive (conv_id, ts and the archive's columns) are replaced: for a
    reader of images by the lead-in and the archive's blocks under ``most`` bytes, for others by the summary
    and the archive's text, shortened. Where there is no text left, and everywhere else, the message stays.
    """
    named = archives.withColumnsRenamed({c: f"a_{c}" for c in archives.columns if c not in ("conv_id", "ts")}).withColumn("found", F.lit(True))
    met = messages.join(named, ["conv_id", "ts"], "left").withColumn("hit", F.coalesce("found", F.lit(False)) & (F.col("role") == SUMMARY))
    source = F.coalesce(source_text(F.col("a_text"), F.col("a_text_head"), F.col("a_text_tail")), F.lit(""))
    replay = met.withColumn("replay", F.when(F.col("hit") & ~F.col("vision"), source))
    replay = bounded_replay(replay, "replay", "a_text_head", "a_text_tail", F.coalesce("a_lead_in", F.lit("")) != "")
    wrapped = F.concat(F.col("text"), F.lit(f"\n\n{archive.OPEN}\n"), F.col("replay"), F.lit(f"\n{archive.CLOSE}"))
    as_text = F.when(F.col("replay").isNotNull() & ~transcript.is_blank(F.col("replay")), wrapped).otherwise(F.col("text"))
    plain = replay.where(~(F.col("hit") & F.col("vision"))).select("conv_id", "ts", F.lit(0).cast("long").alias("pos"), F.lit("text").alias("type"), as_text.alias("text"), F.lit(None).cast("string").alias("data"))
    seen = met.where(F.col("hit") & F.col("vision"))
    lead = seen.select("conv_id", "ts", F.lit(0).cast("long").alias("pos"), F.lit("text").alias("type"), F.coalesce("a_lead_in", "text").alias("text"), F.lit(None).cast("string").alias("data"))
    one = F.struct("conv_id", "ts").alias("conv_id")
    made = archive.blocks(seen.select(one, *[F.col(f"a_{c}").alias(c) for c in ("frames", "text_head", "text_tail", "truncated_chars")]), most)
    body = made.select("conv_id.conv_id", "conv_id.ts", (F.col("pos") + 1).alias("pos"), "type", "text", "data")
    return plain.unionByName(lead).unionByName(body)
