"""Periodic runs of words, found on a harmonic grid.

A run is a maximal stretch of words with smallest period q that is at least ``max(MIN_LENGTH, 2 q)`` words long. For each
period p the grid has the points 0, p, 2 p, ...: a run of period p and length 2 p or more holds some point i together
with i + p, so the pairs (p, i) see every run. All pairs of a text number about n log n; they are taken in blocks:

1. pairs whose two words differ go, then those that cannot reach far enough to either side;
2. a binary search finds how far the rest agree forward and backward, for all of a block at once, on prefix hashes modulo
   two primes (a search on hashes never stops too early);
3. stretches that several pairs or several multiples of a period found are one run, of the smallest period;
4. the words of each run are compared. Where they do not agree, hashes of different words were equal: that period is
   searched again word by word.

Rows are independent, so nothing is shuffled; a task holds one text and a block of pairs.

Defined cases: a null or empty text has no words and no runs; repeated rows are judged alike; other columns are
carried along, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import fresh, table

MIN_LENGTH = 12
#: Pairs of a period and a grid point that are searched at once (those of one period are never parted).
BLOCK = 1 << 20
PRIMES = (2**31 - 1, 2**31 - 19)
BASES = tuple(int(b) for b in np.random.default_rng(12).integers(2**20, 2**31 - 20, 2))


class PrefixHashes:
    """Whether words from i and from i + p agree for l words: equal words always do, others hardly ever."""

    def __init__(self, words: np.ndarray):
        self.tables = []
        for prime, base in zip(PRIMES, BASES):
            powers = np.ones(1, np.int64)
            while len(powers) <= len(words):
                powers = np.concatenate([powers, powers * pow(base, len(powers), prime) % prime])
            # fewer than 2**32 terms below 2**31: the sum fits
            sums = np.concatenate([[0], np.cumsum((words + 1) * powers[: len(words)] % prime)]) % prime
            self.tables.append((prime, powers, sums))

    def agree(self, i: np.ndarray, p: np.ndarray, length: np.ndarray) -> np.ndarray:
        j, same = i + p, np.ones(len(i), bool)
        for prime, powers, sums in self.tables:
            same &= (sums[i + length] - sums[i]) % prime * powers[p] % prime == (sums[j + length] - sums[j]) % prime
        return same


def longest(low: np.ndarray, high: np.ndarray, holds) -> np.ndarray:
    """For all entries at once the greatest length from ``low`` to ``high`` for which ``holds``."""
    while (low < high).any():
        middle = (low + high + 1) // 2
        ok = holds(middle)
        low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
    return low


def grid(n: int):
    """Blocks of (period, point) pairs of a text of ``n`` words."""
    periods = np.arange(1, n // 2 + 1)
    points = (n - 1) // periods
    ends = np.cumsum(points)
    start = 0
    while start < len(periods):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + BLOCK, "right")))
        p = np.repeat(periods[start:stop], points[start:stop])
        yield p, (np.arange(len(p)) - np.repeat(ends[start:stop] - points[start:stop] - done, points[start:stop])) * p
        start = stop


def candidates(words: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of stretches that are long enough by their hashes."""
    n, hashes, found = len(words), None, []
    for p, i in grid(n):
        alike = words[i] == words[i + p]
        p, i = p[alike], i[alike]
        hashes = hashes or PrefixHashes(words)
        # both ways together have to reach max(p, MIN_LENGTH - p), so one way half of it
        half = (np.maximum(p, MIN_LENGTH - p) + 1) // 2
        fits = i + p + half <= n
        ahead = fits & hashes.agree(i, p, np.where(fits, half, 0))
        fits = i >= half
        behind = fits & hashes.agree(np.where(fits, i - half, i), p, np.where(fits, half, 0))
        p, i = p[ahead | behind], i[ahead | behind]
        forward = longest(np.ones_like(i), n - i - p, lambda l: hashes.agree(i, p, l))
        backward = longest(np.zeros_like(i), i, lambda l: hashes.agree(i - l, p, l))
        start, end = i - backward, i + p + forward
        long = end - start >= np.maximum(MIN_LENGTH, 2 * p)
        found.append(np.unique(np.stack([start, end, p], 1)[long], axis=0))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def stretches(words: np.ndarray, p: int) -> np.ndarray:
    """The same for one period, word by word."""
    change = np.flatnonzero(np.diff(np.concatenate([[0], words[:-p] == words[p:], [0]])))
    start, end = change[::2], change[1::2] + p
    long = end - start >= max(MIN_LENGTH, 2 * p)
    return np.stack([start, end, np.full(len(start), p)], 1)[long]


def find_runs(words: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs of the numbered words, by start, then period."""
    found = candidates(words)
    while True:
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        first = np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(1)])[: len(found)]
        runs = found[first]
        maximal = lambda s, e, p: (s == 0 or words[s - 1] != words[s - 1 + p]) and (e == len(words) or words[e] != words[e - p])
        wrong = {p for s, e, p in runs.tolist() if not (maximal(s, e, p) and np.array_equal(words[s : e - p], words[s + p : e]))}
        if not wrong:
            runs[:, 1] -= runs[:, 0]
            return runs[np.lexsort((runs[:, 2], runs[:, 0]))]
        found = np.concatenate([found[~np.isin(found[:, 2], list(wrong))], *[stretches(words, p) for p in sorted(wrong)]])


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal ones."""
    return pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def runs_udf():
    @F.arrow_udf(f"struct<runs:array<{RUN}>,kept:string>")
    def search(texts: pa.Array) -> pa.Array:
        runs, kept = [], []
        for text in texts.cast(pa.binary()).to_pylist():
            words = text.split() if text else []
            found = find_runs(numbered(words))
            runs.append([{"start": s, "length": l, "period": p} for s, l, p in found.tolist()])
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, found[:, 0] + found[:, 2], 1)
            np.add.at(change, found[:, 0] + found[:, 1], -1)
            kept.append(b" ".join([words[k] for k in np.flatnonzero(change.cumsum()[:-1] == 0).tolist()] if len(found) else words))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(runs, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=["runs", "kept"])

    return search


def collapse_runs(docs: DataFrame, *, text: str = "text", carry: list[str] | None = None, out: str = "periodic") -> tuple[DataFrame, str]:
    """The ``carry`` columns (default: all) with a struct (runs, kept text) in a new column; returns its name too.

    The kept text lacks every word that some run holds after its first period.
    """
    out = fresh(docs, out)
    return docs.select(*(F.col(f"`{c}`") for c in carry or docs.columns), runs_udf()(F.col(text)).alias(out)), out


def repeated_tail_udf():
    @F.arrow_udf("string")
    def repeat(texts: pa.Array, gs: pa.Array) -> pa.Array:
        out = []
        for text, g in zip(texts.cast(pa.binary()).to_pylist(), gs.to_pylist()):
            words = text.split() if text else []
            if not words:
                out.append(text)
                continue
            n, a = len(words), g % len(words)
            tail = words[a : a + 1 + (n - a) // (3 + g % 8)]
            out.append(b" ".join(words[:a] + (tail * -(-(n - a) // len(tail)))[: n - a]))
        return pa.array(out, pa.binary()).cast(pa.string())

    return repeat


def with_repeated_tails(docs: DataFrame, share: int = 10) -> DataFrame:
    """Documents of which one in ``share`` (by its id's crc32) repeats a few of its words to its end; a null id never does."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = h % share == 0
    return docs.withColumn("text", F.when(chosen, repeated_tail_udf()(F.when(chosen, F.col("text")), F.when(chosen, F.floor(h / share)))).otherwise(F.col("text")))


def longest_run(runs: Column) -> Column:
    """Of the longest runs the one with the smallest start, then period; null where there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, out = collapse_runs(with_repeated_tails(table(spark, sf_dir, "documents").select("doc_id", "text")), carry=["doc_id"])
    found = found.withColumns({"runs": F.col(out)["runs"], "kept": F.col(out)["kept"]}).withColumn("best", longest_run(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"),
    )
