"""Repeated archiving as keyed state.

Each conversation's state is its archive text so far and how much it lost. A new round's text is put behind the old
text, laid out under the page budget, and what the layout keeps is the next state, so loss adds up over rounds.
``refold_stream`` keeps the state of a stream in RocksDB, of which a task holds the conversations at hand only;
``refold`` is the fold of an ordered batch. Both use ``fold``, the layout's arithmetic on one text.

Defined cases: a null text counts as a round and adds nothing; rounds of one trigger are taken in order, those of a later
trigger behind all earlier ones; a conversation without rounds in a trigger gives no row in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliant.functions.text import CELL
from foliant.operators.layout import EDGE_PAGES

OUT = "conv_id long, rounds long, text string, truncated long"
STATE = "text string, truncated long, rounds long"
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def keep(text: str, high: int, low: int, most: int) -> tuple[str, int]:
    """What a layout keeps of a text, and how many characters go."""
    if len(text) <= 2 * high:
        return text, 0
    middle = text[high : len(text) - high]
    pages = -(-len(middle) // high)
    if pages <= most:
        return text, 0
    edge = min(EDGE_PAGES, max(0, (most - 1) // 2))
    head, tail = edge * high, len(middle) - (pages - edge) * high if edge else 0
    inner = middle[head : len(middle) - tail]
    gone = max(0, -(-len(inner) // low) - (most - 2 * edge)) * low
    return text[:high] + middle[:head] + inner[gone:] + middle[len(middle) - tail :] + text[len(text) - high :], gone


def fold(text: str, truncated: int, new: str, high: int, low: int, most: int) -> tuple[str, int]:
    joined = CELL.join(x for x in (text, new) if x)
    kept, gone = keep(joined, high, low, most)
    return kept, truncated + gone


def refold(rounds: DataFrame, high: int, low: int, most: int) -> DataFrame:
    """(conv_id, rounds, text, truncated) after all rounds (conv_id, round, text), in order of round."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        text, truncated = "", 0
        for new in rows.sort_values("round")["text"]:
            text, truncated = fold(text, truncated, new or "", high, low, most)
        return pd.DataFrame([(key[0], len(rows), text, truncated)], columns=["conv_id", "rounds", "text", "truncated"])

    return rounds.select("conv_id", "round", "text").groupBy("conv_id").applyInPandas(run, OUT)


class Refold(StatefulProcessor):
    """Folds the rounds that a trigger brings to a conversation into its state."""

    def __init__(self, high: int, low: int, most: int):
        self.page = (high, low, most)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.archive = handle.getValueState("archive", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        text, truncated, n = self.archive.get() or ("", 0, 0)
        arrived = sorted(((r["round"], r["text"]) for r in rows), key=lambda r: r[0])
        for _, new in arrived:
            text, truncated = fold(text, truncated, new or "", *self.page)
        self.archive.update((text, truncated, n + len(arrived)))
        yield Row(conv_id=key[0], rounds=n + len(arrived), text=text, truncated=truncated)

    def close(self) -> None:
        pass


def refold_stream(rounds: DataFrame, high: int, low: int, most: int) -> DataFrame:
    """The same over a stream: a row per conversation for each trigger in which it got rounds."""
    return rounds.select("conv_id", "round", "text").groupBy(F.col("conv_id")).transformWithState(Refold(high, low, most), OUT, "Update", "None")


def follow(spark: SparkSession, rounds: DataFrame, root: str, high: int, low: int, most: int) -> None:
    """Run the stream up to what it holds now; each trigger writes its rows to ``root/states``, a trigger again in place."""

    def commit(states: DataFrame, number: int) -> None:
        states.write.mode("overwrite").parquet(f"{root}/states/batch={number}")

    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        folded = refold_stream(rounds, high, low, most)
        folded.writeStream.outputMode("update").foreachBatch(commit).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER[0], before)


def latest_states(spark: SparkSession, root: str) -> DataFrame:
    """(conv_id, rounds, text, truncated) after all triggers."""
    states = spark.read.option("basePath", f"{root}/states").parquet(f"{root}/states")
    return states.groupBy("conv_id").agg(F.max_by(F.struct("rounds", "text", "truncated"), "rounds").alias("s")).select("conv_id", "s.*")
