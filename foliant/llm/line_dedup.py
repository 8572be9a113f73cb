"""Line dedup by an exact set-similarity join over all lines.

A line is the set of its distinct words; a line goes when an earlier line (smaller doc_id, or same
document and earlier) has a set of Jaccard similarity ``THRESHOLD`` or more. Lines are judged on the
input. Steps, all DataFrame functions:

1. Words get codes that sort by rarity: the corpus count of the word's hash bucket, in quarter powers
   of two, then the word's hash. Counting covers every word; the table has ``BUCKETS`` entries.
2. Equal sets are one class, represented by their earliest line, in one partial aggregation: a line
   with any number of copies goes on as one row. Two sets that are similar but not equal must share a
   word of their prefixes, their rarest words (prefix filter).
3. Star join: a line meets the earliest lines that share one of ``STARS`` MinHash values of its prefix,
   one from each of ``CENTRES`` parts of the corpus, and is compared with the likeliest of them. In a
   family of many similar lines nearly all are similar to that one, and step 4 is left with the few that are not.
4. Lines that are still without an earlier match are posted under all words of their prefixes and meet
   all earlier lines there. Candidates must pass the length filter, the positional filter, which bounds
   the words they can still share by their places in both orders, and a filter on 64 to 256 parity
   bits, more for longer lines, which bounds the words in which they differ. Lines that step 3 removed are met but meet nobody.
5. In both joins the Jaccard similarity of the candidates is verified on the whole sets (of 63-bit
   codes of the words). A Bloom filter of the candidates picks their lines out of the texts, so texts
   are not shuffled for it.
6. Documents keep the representatives without an earlier match, and blank lines.

Very frequent words come last in the order and so are hardly posted. Within a posting list lines meet by
bands of sizes; the bands of one list are joined in the task that has the list.

Defined cases: a null text stays null; lines without words stay; documents left without lines become
an empty text and stay; rows with equal id and text are one document (all keep the same lines), rows
with equal id and other texts are ordered by a hash of the text; null ids come first; other columns
are kept as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import fresh, id_order, stash, table

THRESHOLD = 0.8
BUCKETS = 1 << 16
#: MinHash values of a prefix under which a line meets an earlier one.
STARS = 3
CENTRES = 8
#: Lines of so many words have two, and four, times 64 parity bits: below, unlike lines still differ in far more bits
#: than similar ones may, and each further 64 bits are another walk over the words.
LONG, LONGER = 72, 200
BITS = ["b0", "b1", "b2", "b3"]
#: Bits of the Bloom filter of candidate lines: so many a line, up to a bound of 8 MB.
BITS_PER_LINE, MAX_BITS = 16, 1 << 26
AT = ["d", "h", "ln"]
#: Whether both sides of a join must be dealt by all of its keys.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def spaced(text: Column) -> Column:
    """The text with white space other than line feeds as spaces."""
    other = "\t\x0b\f\r"
    return F.when(reduce(Column.__or__, [text.contains(c) for c in other]), F.translate(text, other, "    ")).otherwise(text)


def bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def rarity(docs: DataFrame) -> Column:
    """By hash bucket: quarter powers of two of the count of its words."""
    one_line = F.replace("spaced", F.lit("\n"), F.lit(" "))  # translate would look up every character
    each = docs.select(F.explode(F.split(one_line, " ")).alias("word")).where("word <> ''")
    ranks = [0] * BUCKETS
    for b, n in each.groupBy(bucket(F.xxhash64("word")).alias("b")).count().collect():  # at most BUCKETS rows
        ranks[b] = min(127, int(4 * math.log2(n)))
    # one literal that folds to an array; an array of literals would make every plan as long as the table
    return F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<bigint>")  # short numbers: they stand in every plan


def codes(line: Column, ranks: Column) -> Column:
    """The line's distinct words as sorted numbers, rare ones first: 7 bits of rarity, 56 of hash."""
    hashes = F.array_distinct(F.transform(F.array_remove(F.split(line, " "), ""), lambda w: F.xxhash64(w)))
    return F.sort_array(F.transform(hashes, lambda h: F.shiftleft(ranks[bucket(h)], 56).bitwiseOR(F.shiftrightunsigned(h, 8))))


def lines_of(docs: DataFrame) -> DataFrame:
    """(d, h, ln, line) of every line; ``docs``: d, h, spaced."""
    return docs.select("d", "h", F.posexplode(F.split("spaced", "\n")).alias("ln", "line"))


def one_bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))


def parities(codes: Column, n: Column) -> list[Column]:
    """64 bits, each the parity of the number of words that hash to it; of long lines the same of some parts of the words.

    Two sets differ in no fewer words than bits. The first part needs no walk of its own: ``differ`` takes the others from the whole.
    """
    parts = F.when(n < LONG, 0).when(n < LONGER, 1).otherwise(3)
    zero = F.lit(0).cast("long")
    of = lambda i: F.aggregate(codes, zero, lambda acc, c: acc.bitwiseXOR(F.call_function("shiftleft", (F.shiftright(c, 6).bitwiseAND(parts) == i).cast("long"), c.bitwiseAND(F.lit(63)).cast("int"))))
    whole = F.aggregate(codes, zero, lambda acc, c: acc.bitwiseXOR(one_bit(c)))
    return [whole, *[F.when(parts >= i, of(i)).otherwise(zero) for i in range(1, len(BITS))]]


def representatives(docs: DataFrame, ranks: Column, threshold: float) -> DataFrame:
    """One row per distinct set that can be similar to another: its earliest line (d, h, ln), size, prefix and parity bits.

    The others, too small or without similar sets because the threshold is 1, come along with a null prefix.
    """
    coded = lines_of(docs).select(*AT, codes(F.col("line"), ranks).alias("codes"))
    n = F.size("codes")
    # the likest unequal set has one word more
    joins = n >= math.ceil(threshold / (1 - threshold) - 1e-9) if threshold < 1 else F.lit(False)
    prefix = F.when(joins, F.slice("codes", F.lit(1), (n - F.ceil(threshold * n - 1e-9) + 1).cast("int")))
    r = F.struct(*AT, n.alias("n"), prefix.alias("prefix"), *[x.alias(b) for x, b in zip(parities(F.col("codes"), n), BITS)])
    keyed = coded.select(F.xxhash64("codes").alias("k1"), F.xxhash64(F.lit(1), "codes").alias("k2"), r.alias("r"))
    # blank lines go only here: a filter before would be computed from the text once more
    return keyed.groupBy("k1", "k2").agg(F.min("r").alias("r")).select("r.*").where("n > 0")


def sided(lines: DataFrame, side: str, *same: str) -> DataFrame:
    """Columns renamed to one side of a join, but for ``same``."""
    return lines.select(*[F.col(c) if c in same else F.col(c).alias(c + side) for c in lines.columns])


def is_later(x: str = "x", y: str = "y") -> Column:
    """Whether x comes after y."""
    d, h, ln = ((F.col(c + x), F.col(c + y)) for c in AT)
    return (d[0] > d[1]) | ((d[0] == d[1]) & ((h[0] > h[1]) | ((h[0] == h[1]) & (ln[0] > ln[1]))))


def least_overlap(nx: Column, ny: Column, threshold: float) -> Column:
    """Words that sets of sizes nx and ny share at least when they are similar."""
    return F.ceil(threshold / (1 + threshold) * (nx + ny) - 1e-9)


def differ(nx: Column, ny: Column, x: str = "x", y: str = "y") -> Column:
    """Words at least in which x and y differ, from the parity bits that both have."""
    whole, *rest = [F.col(b + x).bitwiseXOR(F.col(b + y)) for b in BITS]
    least, odd = F.least(nx, ny), rest[0].bitwiseXOR(rest[2])
    four = sum((F.bit_count(z) for z in rest), F.bit_count(reduce(Column.bitwiseXOR, rest, whole)))
    two = F.bit_count(whole.bitwiseXOR(odd)) + F.bit_count(odd)
    return F.when(least < LONG, F.bit_count(whole)).when(least < LONGER, two).otherwise(four)


def near_enough(x: str, y: str, threshold: float) -> Column:
    """Parity filter of the lines x and y."""
    nx, ny = F.col("n" + x), F.col("n" + y)
    return differ(nx, ny, x, y) <= nx + ny - 2 * least_overlap(nx, ny, threshold)


def may_be_similar(nx: Column, ny: Column, threshold: float) -> Column:
    """Length and parity filters of the lines x and y."""
    return (F.least(nx, ny) >= threshold * F.greatest(nx, ny) - 1e-9) & near_enough("x", "y", threshold)


def star_pairs(reps: DataFrame, threshold: float) -> DataFrame:
    """Lines x, each with the likeliest y of the earliest lines that share a MinHash value of the prefix."""
    value = lambda i: F.array_min(F.transform("prefix", lambda c: F.xxhash64(c, F.lit(i))))
    # both sides of the join are made of this one exchange, so no condition is on one side alone
    own = reps.where("prefix is not null and n is not null").select(*AT, "n", *BITS, F.explode(F.array(*[value(i) for i in range(STARS)])).alias("key")).repartition("key")
    part = F.pmod(F.xxhash64(*AT), F.lit(CENTRES)).alias("part")
    first = own.groupBy("key", part).agg(F.min(F.struct(*AT, "n", *BITS)).alias("y")).select("key", "y")
    met = sided(own, "x", "key").join(first, "key")
    met = met.select(*[c + "x" for c in (*AT, "n", *BITS)], *[F.col(f"y.{c}").alias(c + "y") for c in (*AT, "n", *BITS)])
    x, y = ([c + side for c in AT] for side in "xy")
    nx, ny = F.col("nx"), F.col("ny")
    likely = met.where(is_later() & may_be_similar(nx, ny, threshold)).groupBy(*x).agg(F.min(F.struct(differ(nx, ny).alias("far"), *y)).alias("y"))
    return likely.select(*x, *[F.col(f"y.{c}") for c in y])


def prefix_pairs(reps: DataFrame, threshold: float) -> DataFrame:
    """Open lines x (``open`` 1) with all earlier lines y that share a word of their prefixes and pass the filters.

    Of a pair the smaller set (p) needs a shorter prefix only, because it must share more of its words, and the larger
    one (q) is of the same band of sizes or the next. Both sides of the join are made of one exchange, by words, so the
    bands are dealt behind it and no condition is on one side alone.
    """
    posted = reps.where("prefix is not null and n is not null").select(*AT, "n", "open", *BITS, F.posexplode("prefix").alias("i", "code")).repartition("code")
    n = F.col("n")
    # a little wider than the ratio of similar sizes, so that rounding leaves no pair two bands apart
    band = F.coalesce(F.floor(F.log(n) / (-math.log(threshold) * (1 + 1e-6) if threshold < 1 else 1)).cast("int"), F.lit(-1))
    short = F.col("i") < n - F.ceil(2 * threshold / (1 + threshold) * n - 1e-9) + 1
    near = F.explode(F.array(F.when(short, band), F.when(short, band + 1))).alias("band")
    met = sided(posted.select("*", near), "p", "code", "band").join(sided(posted.withColumn("band", band), "q", "code", "band"), ["code", "band"])
    np_, nq, ip, iq = (F.col(c) for c in ("np", "nq", "ip", "iq"))
    sizes = (np_ <= nq) & (np_ >= threshold * nq - 1e-9)
    p_later, q_later = is_later("p", "q"), is_later("q", "p")
    open_later = (p_later & (F.col("openp") == 1)) | (q_later & (F.col("openq") == 1))
    reachable = F.least(np_ - ip, nq - iq) >= least_overlap(np_, nq, threshold)
    found = met.where(sizes & reachable & open_later & near_enough("p", "q", threshold))
    ordered = [F.when(p_later, F.col(c + s)).otherwise(F.col(c + t)).alias(c + side) for side, s, t in (("x", "p", "q"), ("y", "q", "p")) for c in AT]
    return found.select(*ordered).distinct()


def maybe_among(asked: DataFrame) -> Column:
    """A condition on (d, h, ln) that holds for all rows of ``asked`` and few others: one bit each in a filter of bounded size."""
    n = max(64, min(MAX_BITS, 1 << (BITS_PER_LINE * max(1, asked.count())).bit_length()))
    place = F.xxhash64(*AT).bitwiseAND(F.lit(n - 1))
    held = asked.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("i")).agg(F.bit_or(one_bit(F.col("p"))).alias("bits"))
    dense = asked.sparkSession.range(n >> 6).join(held, F.col("id") == F.col("i"), "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    words_ = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"])).scalar()
    return words_[F.shiftright(place, 6).cast("int")].bitwiseAND(one_bit(place)) != 0


def verified(docs: DataFrame, pairs: DataFrame, ranks: Column, threshold: float) -> DataFrame:
    """(d, h, ln) of the lines x that are similar to their y."""
    pairs = stash(pairs)
    sides = [pairs.select(*[F.col(c + s).alias(c) for c in AT]) for s in "xy"]
    asked = stash(sides[0].unionByName(sides[1]).distinct())
    sets = stash(lines_of(docs).where(maybe_among(asked)).select(*AT, codes(F.col("line"), ranks).alias("set")).dropDuplicates(AT))
    both = pairs.join(sided(sets, "x"), [c + "x" for c in AT]).join(sided(sets, "y"), [c + "y" for c in AT])
    shared = F.size(F.array_intersect("setx", "sety"))
    similar = shared >= threshold * (F.size("setx") + F.size("sety") - shared) - 1e-9
    return stash(both.where(similar).select(*[F.col(c + "x").alias(c) for c in AT]).distinct())


@contextmanager
def dealt_by_words(spark: SparkSession) -> Iterator[None]:
    """Rows dealt by one key of a join are not dealt again by all of its keys."""
    before = spark.conf.get(ALL_KEYS)
    spark.conf.set(ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(ALL_KEYS, before)


def matched(docs: DataFrame, reps: DataFrame, ranks: Column, threshold: float) -> DataFrame:
    """(d, h, ln) of representatives with an earlier line that is similar."""
    joins = reps.where(F.col("prefix").isNotNull())
    stars = verified(docs, star_pairs(joins, threshold), ranks, threshold)
    marked = joins.join(stars.withColumn("gone", F.lit(True)), AT, "left").withColumn("open", F.when(F.col("gone").isNull(), 1).otherwise(0)).drop("gone")
    with dealt_by_words(docs.sparkSession):
        return stars.unionByName(verified(docs, prefix_pairs(marked, threshold), ranks, threshold))


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with repeated lines removed from the text; all columns stay. ``threshold``: above 0, 1 at most."""
    d, h, kept_lines, lines = (fresh(docs, c) for c in ("_d", "_h", "_kept", "_lines"))
    repeated = not docs.groupBy(doc_id).count().where("count > 1").isEmpty()
    hashed = F.xxhash64(text) if repeated else F.lit(0).cast("long")  # tells texts of one id apart
    named = docs.select(id_order(doc_id).alias("d"), hashed.alias("h"), spaced(F.col(text)).alias("spaced")).where(F.col(text).isNotNull())
    ranks = rarity(named)
    reps = stash(representatives(named, ranks, threshold))
    gone = matched(named, reps, ranks, threshold)
    kept = reps.select(*AT).join(gone, AT, "left_anti").groupBy("d", "h").agg(F.collect_list("ln").alias(kept_lines))
    # lines are split before the join, so that picking one is a step in an array
    keyed = docs.withColumn(d, id_order(doc_id)).withColumn(h, hashed).withColumn(lines, F.split(text, "\n")).drop(text)
    joined = keyed.join(kept.withColumnsRenamed({"d": d, "h": h}), [d, h], "left")
    blank = F.transform(lines, lambda line, i: F.when(~line.rlike(r"[^ \t-\r]"), i))
    keep = F.sort_array(F.concat(F.coalesce(kept_lines, F.array().cast("array<int>")), F.array_compact(blank)))
    return joined.withColumn(text, F.array_join(F.transform(keep, lambda i: F.col(lines)[i]), "\n")).select(*docs.columns)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("text"))
    before = fresh(docs, "before")
    found = dedup_lines(docs.withColumn(before, F.size(F.split(F.coalesce("text", F.lit("")), "\n"))))
    after = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(F.split("text", "\n")))
    return found.select("doc_id", F.col(before).cast("long").alias("n_lines"), after.cast("long").alias("n_kept"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
