"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every run of ``window`` consecutive words of a benchmark item is a test string (an item with fewer
words is one test string). Texts are scanned with the Wu-Manber tables, one set for each test-string
length: the shift table says how far the next possible occurrence is from a block of words, the
buckets of the blocks that end a test string, split by its first block, select the test strings, and
a direct comparison of the words confirms each occurrence.

The scan is one narrow pass over the documents, whatever their sizes or copies: no shuffle, so no
skew. The benchmark goes through the driver to the executors in blocks of at most ``block_bytes`` of
text (a longer item is a block of its own), so the tables that a Python worker holds have a bounded
size; beyond one block the documents are scanned block by block, with the hits so far written to the
shared folder in between.

Defined cases: a null or empty text has no words and no hits; an item that is null or has no words
holds no test string; repeated items and repeated documents are judged one by one; an empty benchmark
leaves every document clean; an item whose id is null counts like any other and has no name in lists of ids.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import fresh, stash, table

WINDOW = 13
#: Text of the items whose tables a Python worker holds at once; they take about 80 times as much memory.
BLOCK_BYTES = 2 << 20
SHARE = 20

#: Folds A-Z and turns every byte outside 0-9, a-z and non-ASCII into a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Scanner:
    """Wu-Manber tables of the test strings of one length. Test strings are places in ``words``, the words of all items."""

    def __init__(self, length: int, words: list[bytes]):
        self.length, self.block, self.words = length, min(2, length), words
        self.default = length - self.block + 1
        #: Block of words -> how far the next possible end is, or the places of the test strings that end with the block.
        self.table: dict[tuple, int | list[int]] = {}
        self.known: set[tuple] = set()

    def add(self, start: int) -> None:
        """Take the test string at ``start``, but for one that is known."""
        pattern = tuple(self.words[start : start + self.length])
        if pattern in self.known:
            return
        self.known.add(pattern)
        for end in range(self.block, self.length + 1):
            key, step = pattern[end - self.block : end], self.length - end
            old = self.table.get(key, self.default)
            if not step:
                self.table[key] = [*old, start] if isinstance(old, list) else [start]
            elif not isinstance(old, list):
                self.table[key] = min(old, step)

    def scan(self, text: list[bytes]) -> Iterator[int]:
        """Start of each occurrence."""
        length, block, table, default, words = self.length, self.block, self.table, self.default, self.words
        end, n = length, len(text)
        while end <= n:
            found = table.get(tuple(text[end - block : end]), default)
            if isinstance(found, int):
                end += found
                continue
            start = end - length
            first = text[start]
            if any(words[at] == first and words[at : at + length] == text[start:end] for at in found):
                yield start
            end += 1


class Tables:
    """Scanners of a block of items, and the items by test string."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        same: dict[bytes, bytes] = {}  # one object for equal words
        all_words: list[bytes] = []
        self.scanners: dict[int, Scanner] = {}
        self.items: dict[bytes, list[int]] = {}
        self.names = [item for item, _ in items]
        for number, (_, text) in enumerate(items):
            own = [same.setdefault(w, w) for w in words(text)]
            if not own:
                continue
            base, length = len(all_words), min(window, len(own))
            all_words += own
            scanner = self.scanners.setdefault(length, Scanner(length, all_words))
            for i in range(len(own) - length + 1):
                scanner.add(base + i)
                holders = self.items.setdefault(digest(own[i : i + length]), [])
                if not holders or holders[-1] != number:
                    holders.append(number)
        for scanner in self.scanners.values():
            scanner.known = set()

    def scan(self, text: list[bytes]) -> tuple[set[int], set[str | None]]:
        """Hit places and names of the items whose test strings occur."""
        places, names = set(), set()
        for length, scanner in self.scanners.items():
            for start in scanner.scan(text):
                places.update(range(start, start + length))
                names.update(self.names[i] for i in self.items[digest(text[start : start + length])])
        return places, names


def digest(test_string: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(test_string), digest_size=16).digest()


def item_blocks(items: DataFrame, item_id: str, item_text: str, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in blocks of bounded size; one block is on the driver at a time."""
    block, size = [], 0
    rows = items.select(F.col(item_id).cast("string"), F.col(item_text)).where(F.col(item_text).isNotNull())
    for item, text in rows.toLocalIterator():
        raw = text.encode()
        if block and size + len(raw) > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, raw))
        size += len(raw)
    yield block


_TABLES: dict[str, Tables] = {}


def scanner_udf(spark: SparkSession, block: list[tuple[str | None, bytes]], window: int):
    """text, hit positions so far, items so far -> n_words, hit positions, items."""
    sent, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

    @F.arrow_udf("struct<n_words:bigint,hits:binary,items:array<string>>")
    def scan(texts: pa.Array, hits: pa.Array, items: pa.Array) -> pa.Array:
        if key not in _TABLES:
            _TABLES.clear()
            _TABLES[key] = Tables(sent.value, window)
        out_n, out_hits, out_items = [], [], []
        for text, old, seen in zip(texts.cast(pa.binary()).to_pylist(), hits.to_pylist(), items.to_pylist()):
            doc = words(text)
            positions = set(np.frombuffer(old, "<u4").tolist()) if old else set()
            found = set(seen or ())
            places, names = _TABLES[key].scan(doc)
            positions |= places
            found |= names
            out_n.append(len(doc))
            out_hits.append(np.array(sorted(positions), "<u4").tobytes())
            out_items.append(sorted(found, key=lambda x: (x is None, x or "")))
        return pa.StructArray.from_arrays(
            [pa.array(out_n, pa.int64()), pa.array(out_hits, pa.binary()), pa.array(out_items, pa.list_(pa.string()))],
            names=["n_words", "hits", "items"],
        )

    return scan


def scan(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, out: str = "contamination") -> tuple[DataFrame, str]:
    """``docs`` with a struct (n_words, n_hit, items, contaminated) in a new column; returns its name too."""
    spark, out = docs.sparkSession, fresh(docs, out)
    empty = F.struct(F.lit(0).cast("long").alias("n_words"), F.lit(b"").alias("hits"), F.array().cast("array<string>").alias("items"))
    seen, first = docs.withColumn(out, empty), True
    for block in item_blocks(items, item_id, item_text, block_bytes):
        seen = seen if first else stash(seen)
        first = False
        seen = seen.withColumn(out, scanner_udf(spark, block, window)(F.col(text), F.col(out)["hits"], F.col(out)["items"]))
    hit = F.length(F.col(out)["hits"]).cast("long") / 4
    n, n_hit = F.col(out)["n_words"], hit.cast("long")
    return seen.withColumn(
        out,
        F.struct(n.alias("n_words"), n_hit.alias("n_hit"), F.col(out)["items"].alias("items"), ((n_hit > 0) & (SHARE * n_hit >= n)).alias("contaminated")),
    ), out


def remove_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    seen, out = scan(docs, items, **options)
    return seen.where(~F.col(out)["contaminated"]).drop(out)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen, out = scan(docs, table(spark, sf_dir, "benchmark"))
    return seen.select(
        "doc_id",
        F.col(out)["n_words"].alias("n_words"),
        F.col(out)["n_hit"].alias("n_hit"),
        F.size(F.col(out)["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(F.col(out)["items"]), ",").cast("binary"), 256).alias("items_sha256"),
        F.col(out)["contaminated"].alias("contaminated"),
    )


ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS key
  FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), t AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS key
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p))
), h AS (SELECT t.doc_id, t.m, t.i, p.item_id FROM t JOIN p USING (m, key)),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS at FROM h) GROUP BY doc_id),
e AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(e.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(e.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN e USING (doc_id)
"""
