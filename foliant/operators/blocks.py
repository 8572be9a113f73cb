"""Messages of typed blocks as the parts of a transcript.

A message is a row (conv_id, turn, role, blocks, call_id): ``blocks`` is an array of structs (type, text,
call_id, name, args), ``args`` an array of (k, v_json) in order, and ``call_id`` names the call that a
message of role ``toolResult`` answers. Texts, thoughts and calls are blocks of an assistant's message;
blocks of other types are ignored. The parts go to ``transcript.sections``.

Blocks are exploded and regrouped by message, so the work is dealt out by conversation and turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import SECTION_TAGS, strip_marks
from foliant.operators import transcript

BLOCKS = "array<struct<type:string,text:string,call_id:string,name:string,args:array<struct<k:string,v_json:string>>>>"


def text_of(blocks: Column) -> Column:
    """The text blocks of a message in order, without anything between them."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "")


def exploded(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, i, type, text, call_id, name, args, stretch) of the assistants' blocks; a call ends a stretch."""
    each = messages.where(F.col("role") == "assistant").select("conv_id", "turn", F.posexplode("blocks").alias("i", "b")).select("conv_id", "turn", "i", "b.*")
    before = Window.partitionBy("conv_id", "turn").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("stretch", F.coalesce(F.count_if(F.col("type") == "toolCall").over(before), F.lit(0)))


def spoken(blocks: DataFrame, thinking: bool) -> DataFrame:
    """Thoughts and texts of each stretch, joined by line breaks: parts (conv_id, at, prefix, text)."""
    kinds = ["thinking", "text"] if thinking else ["text"]
    clean = blocks.where(F.col("type").isin(kinds)).withColumn("text", strip_marks(F.col("text"))).where(~transcript.is_blank(F.col("text")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "\n")
    parts = clean.groupBy("conv_id", "turn", "stretch", "type").agg(joined.alias("text"))
    is_thought = F.col("type") == "thinking"
    return parts.select("conv_id", place(F.when(is_thought, 0).otherwise(1)), F.when(is_thought, SECTION_TAGS["think"]).otherwise(SECTION_TAGS["ai"]).alias("prefix"), "text")


def place(kind: Column | int) -> Column:
    """Where a part stands in its conversation: thoughts before texts, and both before the call that ends their stretch."""
    return F.struct("turn", "stretch", (F.lit(kind) if isinstance(kind, int) else kind).alias("kind")).alias("turn")


def parts(messages: DataFrame, thinking: bool = True) -> DataFrame:
    """(conv_id, turn, prefix, text): all parts of the conversations, ``turn`` being their order.

    The last non-empty result of a call is shown with the call; results without an earlier call stand by
    themselves where they came.
    """
    at_turn = messages.withColumn("stretch", F.lit(0).cast("long"))
    asked = at_turn.where(F.col("role") == "user").withColumn("text", text_of(F.col("blocks"))).where("text <> ''")
    asked = asked.select("conv_id", place(0), F.lit(SECTION_TAGS["user"]).alias("prefix"), strip_marks(F.col("text")).alias("text"))
    blocks = exploded(messages)
    results = at_turn.where(F.col("role") == "toolResult").select("conv_id", "call_id", F.col("turn").alias("seq"), "stretch", text_of(F.col("blocks")).alias("text"))
    called = blocks.where(F.col("type") == "toolCall").select("conv_id", "call_id", F.struct("turn", "stretch").alias("seq"), "name", F.coalesce("args", F.array().cast("array<struct<k:string,v_json:string>>")).alias("args"))
    shown = transcript.calls_with_results(called, results).select("conv_id", F.struct("seq.turn", "seq.stretch", F.lit(2).alias("kind")).alias("turn"), "text")
    loose = transcript.orphans(called.withColumn("seq", F.col("seq.turn")), results).select("conv_id", F.struct(F.col("seq").alias("turn"), F.lit(0).cast("long").alias("stretch"), F.lit(0).alias("kind")).alias("turn"), "text")
    tools = shown.unionByName(loose).select("conv_id", "turn", F.lit(SECTION_TAGS["tool"]).alias("prefix"), "text")
    return asked.unionByName(spoken(blocks, thinking)).unionByName(tools)


def transcripts(messages: DataFrame, thinking: bool = True) -> DataFrame:
    """(conv_id, text): the conversations as tagged text."""
    ordered = F.array_sort(F.collect_list(F.struct("section", "text")))
    return transcript.sections(parts(messages, thinking)).groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))
