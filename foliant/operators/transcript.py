"""Conversations as tagged text: message filters, sections, tool calls with their results.

Messages are rows (conv_id, turn, role, text). A conversation becomes one text, so its rows meet in
one group: that is the size of the result. Within it only (turn, text) pairs are held.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import ARG_CHARS, CALL_CHARS, DIM_OFF, DIM_ON, HEAD_SHARE, RESULT_CHARS, SECTION_TAGS, SPACES, elide_data_urls, strip_marks, truncate_middle


def is_blank(text: Column) -> Column:
    """Whether a text holds only white space."""
    return ~text.rlike(f"[^{SPACES}]")


def in_slices(*slices: DataFrame) -> DataFrame:
    """Slices of the same conversations as one table, each behind the one before: ``turn`` becomes (slice, turn), which sorts.

    Slices number their own turns, so equal turns of two slices are two messages. Columns that a slice lacks are null.
    """
    marked = [s.withColumn("turn", F.struct(F.lit(i).alias("slice"), F.col("turn").cast("long").alias("turn"))) for i, s in enumerate(slices)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def said(messages: DataFrame) -> DataFrame:
    """User and assistant messages that say something, without ink marks. A user's text need only be non-empty as given."""
    clean = strip_marks(F.col("text"))
    speaks = F.when(F.col("role") == "user", F.col("text") != "").when(F.col("role") == "assistant", ~is_blank(clean)).otherwise(F.lit(False))
    return messages.where(speaks).withColumn("text", clean)


def tagged(messages: DataFrame) -> DataFrame:
    """Messages with the tag of their section."""
    return said(messages).withColumn("prefix", F.when(F.col("role") == "user", SECTION_TAGS["user"]).otherwise(SECTION_TAGS["ai"]))


def join_parts(parts: Column, first: Column) -> Column:
    """Texts of one section: a line break between them unless one is there already."""

    def add(acc: Column, text: Column) -> Column:
        gap = F.when(F.endswith(acc, F.lit("\n")) | F.startswith(text, F.lit("\n")), "").otherwise("\n")
        return F.concat(acc, gap, text)

    return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)), F.concat(first, parts[0]), add)


def sections(parts: DataFrame) -> DataFrame:
    """(conv_id, section, prefix, text): consecutive parts (conv_id, turn, prefix, text) of one tag merged."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    starts = F.when(F.lag("prefix").over(order).eqNullSafe(F.col("prefix")), 0).otherwise(1)
    numbered = parts.withColumn("starts", starts).withColumn("section", F.sum("starts").over(order))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    merged = numbered.groupBy("conv_id", "section", "prefix").agg(texts.alias("texts"))
    return merged.select("conv_id", "section", "prefix", join_parts(F.col("texts"), F.col("prefix")).alias("text"))


def transcripts(messages: DataFrame) -> DataFrame:
    """(conv_id, text): the sections of each conversation, a blank line between them."""
    ordered = F.array_sort(F.collect_list(F.struct("section", "text")))
    return sections(tagged(messages)).groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))


def last_results(results: DataFrame) -> DataFrame:
    """The last non-empty result text of each call; ``results``: conv_id, call_id, seq, text."""
    return results.where(F.col("text") != "").groupBy("conv_id", "call_id").agg(F.max_by("text", "seq").alias("result"))


def shown_results(results: DataFrame, dim: bool = True) -> DataFrame:
    """The last result of each call as it is shown: cleaned, shortened, dim. Each step is a column, so that none is computed twice."""
    clean = last_results(results).withColumn("result", strip_marks(F.col("result"))).withColumn("result", elide_data_urls(F.col("result")))
    body = truncate_middle(F.col("result"), RESULT_CHARS, HEAD_SHARE)
    return clean.withColumn("result", F.concat(F.lit("<out>\n" + DIM_ON * dim), body, F.lit(DIM_OFF * dim + "\n</out>")))


def arguments(text: Column) -> Column:
    """Arguments of a call, a JSON object, as an array of (k, v_json) in the order of the text.

    Each value is written as JSON again: nested values keep the order of their keys, white space goes. The value's
    variant type tells a text from what only looks like it. Text that is no object has no arguments.
    """
    raw, typed = F.from_json(text, "map<string,string>"), F.from_json(text, "map<string,variant>")
    quoted = lambda v: F.btrim(F.to_json(F.array(v)), F.lit("[]"))  # noqa: E731 - a JSON text has quotes at both ends
    written = lambda v, kind: F.when(v.isNull(), "null").when(F.schema_of_variant(kind) == "STRING", quoted(v)).otherwise(v)
    # side by side, because what a lambda names from outside is computed anew for each element
    pairs = F.arrays_zip(F.map_entries(raw).alias("e"), F.map_values(typed).alias("kind"))
    shown = F.transform(pairs, lambda p: F.struct(p["e"]["key"].alias("k"), written(p["e"]["value"], p["kind"]).alias("v_json")))
    return F.coalesce(shown, F.array().cast("array<struct<k:string,v_json:string>>"))


def call_line(name: Column, args: Column) -> Column:
    """A call as ``name(key=value, ...)``; ``args``: array of (k, v_json) in order."""
    clean = F.transform(args, lambda a: F.struct(a["k"].alias("k"), elide_data_urls(a["v_json"]).alias("v")))
    shown = F.transform(clean, lambda a: F.concat(a["k"], F.lit("="), truncate_middle(a["v"], ARG_CHARS, HEAD_SHARE)))
    # an array of one line, so that it is computed once
    line = F.transform(F.array(F.array_join(shown, ", ")), lambda s: truncate_middle(s, CALL_CHARS, HEAD_SHARE))[0]
    return F.concat(name, F.lit("("), line, F.lit(")"))


def calls_with_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls (conv_id, call_id, seq, name, args) with the result folded into each; calls without a result stay."""
    found = calls.join(shown_results(results), ["conv_id", "call_id"], "left").withColumn("line", call_line(F.col("name"), F.col("args")))
    text = F.when(F.col("result").isNotNull(), F.concat(F.col("line"), F.lit("\n"), F.col("result"))).otherwise(F.col("line"))
    return found.select("conv_id", "call_id", "seq", text.alias("text"))


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results without an earlier call, each shown with the last text of its id."""
    first = calls.groupBy("conv_id", "call_id").agg(F.min("seq").alias("call_seq"))
    loose = results.join(first, ["conv_id", "call_id"], "left").where(F.col("call_seq").isNull() | (F.col("call_seq") > F.col("seq")))
    shown = loose.join(shown_results(results), ["conv_id", "call_id"])
    return shown.select("conv_id", "call_id", "seq", F.concat(F.lit("\n"), F.col("result")).alias("text"))
