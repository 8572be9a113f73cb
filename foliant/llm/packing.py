"""Best-fit packing of tokenized documents by linear grouping.

Documents become token ids plus an end id; longer ones are cut so that only their first piece may be
shorter than a sequence. Full pieces are sequences of their own. For the others the packer looks at
the histogram of piece lengths alone, which has at most ``capacity`` rows however many documents
there are:

1. lengths above ``small`` are dealt into ``groups`` groups of equal cardinality, each rounded up to
   its largest length (linear grouping);
2. configurations, that is multisets of the few rounded lengths that fit a sequence, are chosen
   greedily by how well they fill it, each as often as the groups allow;
3. the slots of a group take its actual documents in order of length, which leaves each sequence
   its true rest;
4. the small lengths go, longest first, into the sequences with the smallest rest that fits, and open
   new sequences when none does.

Where step 4 alone, for all lengths, needs fewer sequences, that plan is taken instead.

The plan is a list of runs: "documents of length L with ranks a..b go to sequences s, s+1, ... at
offset o". Ranks of equal lengths are dealt by windows over (length, salt); the histogram gives a length
one salt for each ``WINDOW_ROWS`` of its pieces, so a very frequent length is spread over many tasks.
Each document finds its run by bisection in the plan. Full pieces need no rank: their sequences are
numbered where they are read.

Defined cases: a null text counts as empty (only the end id); repeated rows are packed one by one; an
empty table gives no rows; equal lengths are interchangeable, ties go by salt and id.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import fresh, stash, table

CAPACITY = 2048
SMALL = 512
GROUPS = 128
#: Pieces of one length that are ranked in one window, about.
WINDOW_ROWS = 100_000
END_ID = 0
#: Remembered words of a Python worker, in each of two generations.
CACHE = 320_000
#: Texts encoded at once, in bytes: each distinct word of a batch is looked up once, so few large batches cost less.
BATCH_BYTES = 8 << 20

#: White space other than the space and the line feed; texts that have any are encoded whole.
RARE_SPACE = re.compile(r"[^\S \n]")
ENDED = re.compile(r"([^\W\d_]+)([^\w\s]+)\Z")
_ENCODERS: dict[str, "Encoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def beside_space(text: str) -> bool:
    """Whether a space touches other white space or an end of the text, so that it may not start a token."""
    return "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or RARE_SPACE.search(text) is not None


class Encoder:
    """Token ids as little-endian bytes.

    A word after a single space always starts a token of this vocabulary's splitter, so words are
    encoded once and remembered. Of the two generations of remembered words the older goes when the
    younger is full; words still in use move to the younger one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts that hold one of the vocabulary's own tokens, which may span words, are encoded whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def raw(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def letters(self, words: list[str]) -> list[bytes]:
        """Encodings of words of letters only, each after a space: the splitter makes each one unit, so many go in one text."""
        encoded = self.tokenizer.encode("".join([" " + w for w in words]), add_special_tokens=False)
        ids = array("I", encoded.ids).tobytes()
        ends = np.cumsum(np.bincount(encoded.word_ids, minlength=len(words)) * 4).tolist()
        return [ids[i:j] for i, j in zip([0, *ends], ends)]

    def learn(self, words: list[str]) -> None:
        """Take ``words``, each after a space, into the younger generation."""
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        young.update((w, old[w]) for w in words if w not in young and w in old)
        new = [w for w in words if w not in young]
        # letters and closing punctuation are separate units of the splitter
        ended = {w: m.groups() for w in new if not w.isalpha() and (m := ENDED.match(w)) and m[1].isalpha()}
        plain = list({*(w for w in new if w.isalpha()), *(x for x, _ in ended.values() if x not in young)})
        for at in range(0, len(plain), 500):
            young.update(zip(plain[at : at + 500], self.letters(plain[at : at + 500])))
        for mark in {m for _, m in ended.values()} - self.marks.keys():
            self.marks[mark] = self.raw([mark])[0]
        young.update((w, young[x] + self.marks[m]) for w, (x, m) in ended.items())
        mixed = [w for w in new if w not in young]
        young.update(zip(mixed, self.raw([" " + w for w in mixed])))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of every text, each followed by the end id."""
        end, values = array("I", [END_ID]).tobytes(), texts.to_pylist()
        out = [end] * len(values)
        whole = [i for i, t in enumerate(values) if t and (beside_space(t) or any(own in t for own in self.added))]
        for i, ids in zip(whole, self.raw([values[i] for i in whole])):
            out[i] = ids + end
        odd = set(whole)
        plain = [i for i, t in enumerate(values) if t and i not in odd]
        if not plain:
            return out
        split = pc.split_pattern(texts.take(pa.array(plain, pa.int64())), " ")
        offsets = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        words, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        firsts = [words[k] for k in which[offsets[:-1]]]
        self.learn(words)
        parts = [*map(self.young.__getitem__, words), *self.raw(firsts)]
        which = which.astype(np.int64)
        which[offsets[:-1]] = np.arange(len(words), len(parts))  # first words have no space before them
        tokens = np.frombuffer(b"".join(parts), "<u4")
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        starts = np.cumsum(lengths) - lengths
        each = lengths[which]
        ends = np.cumsum(each)
        narrow = np.int32 if ends[-1] < 2**31 else np.int64
        flat = tokens[np.arange(ends[-1], dtype=narrow) + np.repeat((starts[which] - (ends - each)).astype(narrow), each)]
        bounds = np.concatenate([[0], ends])[offsets]
        for i, a, b in zip(plain, bounds.tolist(), bounds[1:].tolist()):
            out[i] = flat[a:b].tobytes() + end
        return out


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32); only the first piece may be shorter than the capacity."""
    n = len(ids) // 4
    first = n % capacity or capacity
    bounds = [0, *range(min(first, n), n + 1, capacity)]
    return [(i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]


def batches(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` in slices of ``BATCH_BYTES``, and one text more, at most."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    number = (np.cumsum(sizes) - sizes) // BATCH_BYTES
    bounds = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(texts)]
    for a, b in zip(bounds, bounds[1:]):
        yield texts[a:b]


def pieces_udf(path: str, capacity: int):
    kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    @F.arrow_udf("array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>")
    def pieces(texts: pa.Array) -> pa.Array:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        out = []
        for batch in batches(texts):
            out += [[dict(zip(("piece", "start", "length", "ids_crc32"), p)) for p in cut(ids, capacity)] for ids in _ENCODERS[path].encode(batch)]
        return pa.array(out, kind)

    return pieces


def groups_of(hist: dict[int, int], small: int, groups: int) -> list[list[tuple[int, int, int]]]:
    """Equal-cardinality groups of the lengths above ``small``: lists of (length, first rank, count), longest group first."""
    large = sorted((n for n in hist if n > small), reverse=True)
    total = sum(hist[n] for n in large)
    each, out, room = max(1, -(-total // groups)), [[]], max(1, -(-total // groups))
    for n in large:
        rank, left = 0, hist[n]
        while left:
            take = min(left, room)
            out[-1].append((n, rank, take))
            rank, left, room = rank + take, left - take, room - take
            if not room:
                out.append([])
                room = each
    return [g for g in out if g]


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Multisets of group numbers that fill a sequence best, each used as often as the counts allow."""
    left, out = list(counts), []
    while any(left):
        start = next(i for i, n in enumerate(left) if n)
        # best filling of the rest with the sizes that are left: reach[r] is the smallest multiset of load r
        reach: dict[int, list[int]] = {sizes[start]: [start]}
        frontier = [sizes[start]]
        while frontier:
            new = []
            for load in frontier:
                for g in range(len(sizes)):
                    grown = load + sizes[g]
                    if left[g] > reach[load].count(g) and grown <= capacity and grown not in reach:
                        reach[grown] = [*reach[load], g]
                        new.append(grown)
            frontier = new
        best = reach[max(reach)]
        times = min(left[g] // best.count(g) for g in set(best))
        for g in best:
            left[g] -= times
        out.append((best, times))
    return out


def plan(hist: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) that place every piece of the histogram."""
    runs: list[tuple[int, int, int, int, int]] = []
    dealt = groups_of(hist, small, groups)
    sizes, counts = [g[0][0] for g in dealt], [sum(c for _, _, c in g) for g in dealt]
    cursor = [[list(x) for x in g] for g in dealt]  # slots take the group's documents in order of length
    rests: dict[int, list[tuple[int, int]]] = defaultdict(list)  # rest -> [(first sequence, how many)]
    sequence = 0
    for slots, times in configurations(sizes, counts, capacity):
        open_runs = [(sequence, times, 0)]
        sequence += times
        for g in slots:
            filled = []
            for first, n, load in open_runs:
                while n:
                    length, rank, count = cursor[g][0]
                    take = min(n, count)
                    runs.append((length, rank, take, first, load))
                    filled.append((first, take, load + length))
                    first, n = first + take, n - take
                    cursor[g][0][1] += take
                    cursor[g][0][2] -= take
                    if not cursor[g][0][2]:
                        cursor[g].pop(0)
            open_runs = filled
        for first, n, load in open_runs:
            rests[capacity - load].append((first, n))
    for length in sorted((n for n in hist if n <= small), reverse=True):
        rank, left = 0, hist[length]
        while left:
            rest = next((r for r in range(length, capacity + 1) if rests.get(r)), None)
            if rest is None:
                n = -(-left // (capacity // length))
                rests[capacity].append((sequence, n))
                sequence, rest = sequence + n, capacity
            first, n = rests[rest].pop()
            take = min(left, n)
            if take < n:
                rests[rest].append((first + take, n - take))
            runs.append((length, rank, take, first, capacity - rest))
            rests[rest - length].append((first, take))
            rank, left = rank + take, left - take
    return runs


def sequences(runs: list[tuple[int, int, int, int, int]]) -> int:
    return max((first + n for _, _, n, first, _ in runs), default=0)


def best_plan(hist: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """The plan by groups, or the one that best-fits all lengths as small ones where that needs fewer sequences: rounding up can cost more than configurations gain."""
    return min(plan(hist, capacity, small, groups), plan(hist, capacity, capacity, groups), key=sequences)


def place_udf(spark: SparkSession, runs: list[tuple[int, int, int, int, int]]):
    """length, rank -> sequence, offset. The plan has few thousand runs, bounded by the capacity."""
    by_length: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for length, rank, _, first, offset in sorted(runs):
        by_length[length].append((rank, first, offset))
    sent = spark.sparkContext.broadcast(dict(by_length))

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        seq, off = [], []
        for length, rank in zip(lengths.to_pylist(), ranks.to_pylist()):
            slots = sent.value[length]
            start, first, offset = slots[bisect_right(slots, (rank, 2**62, 0)) - 1]
            seq.append(first + rank - start)
            off.append(offset)
        return pa.StructArray.from_arrays([pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=["sequence_id", "offset"])

    return place


def ranked(pieces: DataFrame, hist: dict[int, int], *keys: str) -> DataFrame:
    """``pieces`` with a rank from 0 among those of their length, without bringing a length into one task."""
    # one literal that folds to an array: the salts of each length
    salts = F.split(F.lit(",".join(str(1 + hist.get(n, 0) // WINDOW_ROWS) for n in range(max(hist, default=0) + 1))), ",").cast("array<int>")
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys), salts[F.col("length").cast("int")]).cast("int"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each length and salt: at most one a length, and one more for each WINDOW_ROWS pieces
    base = pieces.groupBy("length", "_salt").agg(F.count("*").alias("_n")).select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*keys)) - 1
    return pieces.withColumn("_local", local).join(F.broadcast(base), ["length", "_salt"]).withColumn("rank", F.col("_local") + F.col("_base"))


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cells = fresh(docs, "pieces")
    pieces = stash(
        docs.select(F.col(doc_id).alias("doc_id"), F.explode(pieces_udf(tokenizer or default_tokenizer(), capacity)(F.col(text))).alias(cells)).select("doc_id", f"{cells}.*")
    )
    part = pieces.where(F.col("length") < capacity)
    hist = {r["length"]: r["count"] for r in part.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = best_plan(hist, capacity, small, groups)
    used = sequences(runs)
    at = place_udf(spark, runs)(F.col("length"), F.col("rank"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = ranked(part, hist, "doc_id", "piece", "start", "ids_crc32").withColumn("_at", at).select(*columns, F.col("_at")["sequence_id"].alias("sequence_id"), F.col("_at")["offset"].alias("offset"))
    full = pieces.where(F.col("length") == capacity)
    return placed.unionByName(full.select(*columns, (F.monotonically_increasing_id() + used).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
