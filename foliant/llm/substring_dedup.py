"""Exact removal of repeated passages by recompression.

A window is ``WINDOW`` consecutive words of one document; every word goes that lies in a window whose
words also start earlier (in a document with a smaller id, or earlier in the same one). Windows are
judged on the input.

Recompression gives equal passages equal symbols in their interior: in every round, maximal runs of a
symbol get one name, then the symbols are split by a bit of their name into left and right ones, and
each adjacent left-right pair gets one name. Names are 64-bit functions of what they stand for, so
they are the same in every task and document without a shared table. Each symbol carries the span of
words that its naming depended on.

1. Each window's anchor is its heaviest symbol (most characters) among those that depend on nothing
   outside it, so equal windows have equal anchors. Consecutive windows with one anchor are a segment,
   known by anchor and checksum of its words. A window without an anchor is a segment of its own.
2. Spark gathers the segments by anchor (smallest and largest document, smallest and largest checksum;
   sums combine before the shuffle). Anchors of a single document are done. Where all checksums agree,
   the whole segments are shared: all but the first document's are repeated.
3. Where they differ, the windows of these segments are compared one by one by 128-bit checksums.
4. A last pass marks repeats within each document, joins the marks of steps 2 and 3, and cuts.

Nothing is gathered by group: hot anchors meet in aggregations and in joins that adaptive execution
splits.

Defined cases: a null text has no words, texts of fewer words than a window keep them all; documents
of equal id do not repeat each other (neither is earlier), whatever their texts; a null id comes
first; other columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import fresh, id_order, stash, stashed, table
from foliant.llm.word_hash import U, hash_words, mix

WINDOW = 20
ROUNDS = 2
#: Bytes of text that are parsed at once (a longer document is parsed alone).
BATCH = 2 << 20

BASES = (U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03))


class Powers:
    """Powers of a base and of its inverse, as far as they were needed."""

    def __init__(self, base: np.uint64, inverse: np.uint64):
        self.base, self.inverse = base, inverse
        self.up = self.down = np.zeros(0, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up = np.cumprod(np.concatenate([[U(1)], np.full(size - 1, self.base)]))
            self.down = np.cumprod(np.concatenate([[U(1)], np.full(size - 1, self.inverse)]))
        return self.up[:n], self.down[:n]


POWERS = [Powers(b, U(pow(int(b), -1, 2**64))) for b in BASES]


class Batch:
    """Word hashes of several documents in one array."""

    def __init__(self, texts: list[bytes | None]):
        hashes, self.weights, self.starts = hash_words(texts)
        self.hashes, self.n = hashes[0], len(hashes[0])
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.starts))
        self.powers = [p.to(self.n + 1) for p in POWERS]
        self.sums = [np.concatenate([[U(0)], np.cumsum(hashes[i] * self.powers[i][0][:-1])]) for i in range(2)]
        at = np.arange(self.n)
        self.windows = at[at + WINDOW <= self.starts[1:][self.doc]] if self.n else at

    def checksum(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        """Of the words from start to end, wherever they stand. Both halves have their own hashes of words.

        A sum of powers tells apart stretches of segments and windows, fewer than 2 * WINDOW words; only stretches of
        thousands of words can be made to agree for every base.
        """
        return mix((self.sums[which][end] - self.sums[which][start]) * self.powers[which][1][start] + (end - start).astype(U))

    def symbols(self) -> tuple[np.ndarray, ...]:
        """Names, weights and dependency spans after all rounds."""
        name, weight, doc = self.hashes, self.weights, self.doc
        low, high = np.arange(self.n), np.arange(1, self.n + 1)
        for turn in range(ROUNDS):
            # runs: a symbol is as long as its equal neighbours reach, which both next symbols bound
            begin, end = self.starts[doc] - 1, self.starts[doc + 1] + 1  # what an end of the text depends on: no window holds it
            first = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])]))
            last = np.concatenate([first[1:], [len(name)]]) - 1
            before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(name) - 1)
            low = np.where((first > 0) & (doc[before] == doc[first]), low[before], begin[first])
            high = np.where((last + 1 < len(name)) & (doc[after] == doc[last]), high[after], end[last])
            count = (last - first + 1).astype(U)
            name = np.where(count > 1, mix(name[first] * U(0xC2B2AE3D27D4EB4F) + count), name[first])
            weight, doc = np.add.reduceat(weight, first), doc[first]
            # pairs: a left symbol joins a right one after it
            right = (mix(name + U(turn)) & U(1)).astype(bool)
            joined = np.concatenate([~right[:-1] & right[1:] & (doc[1:] == doc[:-1]), [False]])
            kept = np.flatnonzero(np.concatenate([[True], ~joined[:-1]]))
            begin, end = self.starts[doc] - 1, self.starts[doc + 1] + 1
            before, after = np.maximum(kept - 1, 0), np.minimum(kept + 1, len(name) - 1)
            pair, is_right = joined[kept], right[kept]
            prior = np.where((kept > 0) & (doc[before] == doc[kept]), low[before], begin[kept])
            following = np.where((kept + 1 < len(name)) & (doc[after] == doc[kept]), high[after], end[kept])
            low, high = np.where(is_right, prior, low[kept]), np.where(is_right, high[kept], following)
            weight = weight[kept] + np.where(pair, weight[after], 0)
            name = np.where(pair, mix(name[kept] * U(0xFF51AFD7ED558CCD) + name[after] * U(0xC4CEB9FE1A85EC53)), name[kept])
            doc = doc[kept]
        return name, weight, low, high

    def segments(self) -> tuple[np.ndarray, ...]:
        """Anchor, checksum, first word and number of windows of every segment."""
        p = self.windows
        if not len(p):
            return tuple(np.zeros(0, t) for t in (U, U, np.int64, np.int64))
        name, weight, low, high = self.symbols()
        rank = np.minimum(weight, 4095).astype(U) << U(52) | mix(name) >> U(12)
        a, b = np.searchsorted(low, p), np.searchsorted(high, p + WINDOW, "right")
        size = b - a
        level = np.log2(np.maximum(size, 1)).astype(np.int64)
        # sparse table of the place of the heaviest symbol, the first one of equals
        anchor, table_ = np.full(len(p), -1), np.arange(len(name))
        for k in range(int(level.max()) + 1):
            here = np.flatnonzero((level == k) & (size > 0))
            left, right = table_[a[here]], table_[b[here] - (1 << k)]
            anchor[here] = np.where(rank[right] > rank[left], right, left)
            ahead = np.concatenate([table_[1 << k :], table_[len(table_) - min(1 << k, len(table_)) :]])
            table_ = np.where(rank[ahead] > rank[table_], ahead, table_)
        cut = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1) | (anchor[1:] < 0)])
        first = np.flatnonzero(cut)
        count = np.diff(np.concatenate([first, [len(p)]]))
        start = p[first]
        check = mix(self.checksum(start, start + count - 1 + WINDOW) ^ mix(self.checksum(start, start + count - 1 + WINDOW, 1)))
        own = anchor[first]
        return np.where(own >= 0, name[np.maximum(own, 0)], check), check, start, count


def portions(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of bounded size."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or b"")
        if size > BATCH and i > start:
            yield start, i
            start, size = i, len(text or b"")
    if start < len(texts):
        yield start, len(texts)


def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Batch]]:
    """Rows and their words, in batches of bounded size."""
    for record in rows:
        texts = record["text"].cast(pa.binary()).to_pylist()
        for i, j in portions(texts):
            yield record.slice(i, j - i), Batch(texts[i:j])


def keys(record: pa.RecordBatch, doc: np.ndarray) -> list[pa.Array]:
    return [record[c].take(pa.array(doc)) for c in ("d", "h")]


def segment_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """d, h, text -> a row for every segment."""
    for record, batch in batches(rows):
        anchor, check, start, count = batch.segments()
        doc = batch.doc[start] if len(start) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor.view(np.int64)), pa.array(check.view(np.int64)), *keys(record, doc), pa.array((start - batch.starts[doc]).astype(np.int32)), pa.array(count.astype(np.int32))],
            names=["anchor", "check", "d", "h", "start", "n"],
        )


def window_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """d, h, open segments, text -> a row for every window of these segments."""
    for record, batch in batches(rows):
        at = [np.arange(x["start"], x["start"] + x["n"]) + batch.starts[i] for i, spans in enumerate(record["open"].to_pylist()) for x in spans]
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        doc = batch.doc[at]
        sums = [pa.array(batch.checksum(at, at + WINDOW, i).view(np.int64)) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*sums, *keys(record, doc), pa.array((at - batch.starts[doc]).astype(np.int32))], names=["w1", "w2", "d", "h", "start"])


def repeats(batch: Batch) -> np.ndarray:
    """Windows whose words also start earlier in the same document."""
    one, two = (batch.checksum(batch.windows, batch.windows + WINDOW, i) for i in (0, 1))
    doc = batch.doc[batch.windows]
    order = np.argsort(one + mix(doc.astype(U)), kind="stable")
    a, b = order[:-1], order[1:]
    # equal windows of a document stand together, in order
    return batch.windows[b[(one[a] == one[b]) & (two[a] == two[b]) & (doc[a] == doc[b])]]


def cut_udf():
    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,kept:string>")
    def cut(texts: pa.Array, segments: pa.Array, windows: pa.Array) -> pa.Array:
        raw, segs, starts = texts.cast(pa.binary()).to_pylist(), segments.to_pylist(), windows.to_pylist()
        n, removed, kept = [], [], []
        for i, j in portions(raw):
            batch = Batch(raw[i:j])
            first = batch.starts[:-1].tolist()
            ranges = [(a + s["start"], a + s["start"] + s["n"] - 1 + WINDOW) for a, some in zip(first, segs[i:j]) for s in some or ()]
            single = np.concatenate([repeats(batch), np.array([a + s for a, some in zip(first, starts[i:j]) for s in some or ()], np.int64)])
            hit = np.zeros(batch.n + 1, np.int64)  # changes of the number of repeated windows that cover a word
            np.add.at(hit, single, 1)
            np.add.at(hit, single + WINDOW, -1)
            if ranges:
                begin, end = np.array(ranges).T
                np.add.at(hit, begin, 1)
                np.add.at(hit, end, -1)
            stays = hit.cumsum()[:-1] == 0
            for text, a, b in zip(raw[i:j], first, batch.starts[1:].tolist()):
                words = text.split() if text else []
                own = stays[a:b]
                lost = b - a - int(own.sum())
                n.append(b - a)
                removed.append(lost)
                kept.append(b" ".join([words[k] for k in np.flatnonzero(own).tolist()] if lost else words))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["n_words", "n_removed", "kept"])

    return cut


def dedup_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, out: str = "passages") -> tuple[DataFrame, str]:
    """The ``carry`` columns (default: all) with a struct (n_words, n_removed, kept text) in a new column; returns its name too."""
    out = fresh(docs, out)
    repeated_ids = not docs.groupBy(doc_id).count().where("count > 1").isEmpty()
    h = F.coalesce(F.sha2(F.col(text).cast("binary"), 256), F.lit("")) if repeated_ids else F.lit("")  # tells texts of one id apart
    named = docs.select(id_order(doc_id).alias("d"), h.alias("h"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    segments = named.mapInArrow(segment_rows, "anchor long, check long, d long, h string, start int, n int")
    at = F.struct("start", "n")
    # segments and windows are read twice, so they are written once instead of being parsed from the texts twice
    with stashed(segments) as segments:
        anchors = segments.groupBy("anchor").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.min("check").alias("low"), F.max("check").alias("high")).where("first < last").drop("last")
        shared = segments.join(anchors, "anchor").select("d", "h", "start", "n", (F.col("low") < F.col("high")).alias("open"), (F.col("d") > F.col("first")).alias("later")).where("open or later")
        marks = stash(shared.groupBy("d", "h").agg(F.collect_list(F.when(~F.col("open"), at)).alias("gone"), F.collect_list(F.when(F.col("open"), at)).alias("open")))
    windows = named.join(marks.where(F.size("open") > 0).select("d", "h", "open"), ["d", "h"]).select("d", "h", "open", "text").mapInArrow(window_rows, "w1 long, w2 long, d long, h string, start int")
    with stashed(windows) as windows:
        earliest = windows.groupBy("w1", "w2").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last").drop("last")
        starts = stash(windows.join(earliest, ["w1", "w2"]).where("d > first").groupBy("d", "h").agg(F.collect_list("start").alias("starts")))
    known = marks.select("d", "h", "gone").join(starts, ["d", "h"], "full")
    rows = docs.select(F.struct(*(carry or docs.columns)).alias("row"), id_order(doc_id).alias("d"), h.alias("h"), F.col(text).alias("text"))
    joined = rows.join(known, ["d", "h"], "left")
    return joined.select("row", cut_udf()("text", "gone", "starts").alias(out)).select("row.*", out), out


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, out = dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return found.select("doc_id", F.col(out)["n_words"].alias("n_words"), F.col(out)["n_removed"].alias("n_removed"), F.sha2(F.col(out)["kept"].cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS k FROM t) WHERE k > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS at FROM r),
k AS (SELECT d.doc_id, count(*) AS n, string_agg(x.word, ' ' ORDER BY x.at) AS kept
      FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM d) x JOIN d USING (doc_id) ANTI JOIN g ON g.doc_id = x.doc_id AND g.at = x.at GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
