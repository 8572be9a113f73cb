"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

Texts become sets of word 5-shingles; two documents are linked when their sets' Jaccard similarity is
at least ``THRESHOLD`` percent (or as asked for), confirmed on the full sets. Steps:

1. Equal sets are one class: everything below works on one representative (the smallest id) a class,
   so exact copies, however many, meet in one partial aggregation and nowhere else.
2. A representative is posted under its (coordinate, value) pairs. Linked sets agree in at least
   ``matches_for`` of ``COORDINATES`` values (at the threshold all but about one link in a billion do, more
   similar ones practically always; 34 at 85 percent), so pairs that nobody else has count against a document, and one
   with too few shared pairs is out. The others are posted under their rarest pairs only, as many as
   any two matching documents must overlap in (prefix filter).
3. Star round: in each posting list everyone meets the smallest id. Candidates whose signatures
   collide in that many coordinates are confirmed, links merge into components.
4. Skip round: posting lists that now lie in one component are skipped. In the others, collisions are
   counted between members of different components, part against part. They tell which members of
   which blocks of families must meet; a task gets those of two blocks with their sets, skips pairs that
   are already connected, confirms the others and returns the links that join components. Lists and families are
   dealt out in blocks of bounded size, and no task returns more links than it has members.
5. Components come from label propagation with pointer jumping over the confirmed links.

Defined cases: a null text or one without words has an empty set and is linked with nothing; with
fewer than five words the whole sequence is one shingle; repeated rows share a component; a null id
sorts before all others; other columns are not used.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import LOWEST_ID, fresh, id_order, stash, table
from foliant.llm.word_hash import hash_words, mix

SHINGLE = 5
THRESHOLD = 85
COORDINATES = 64
#: Share of the links at exactly the threshold that may agree in too few coordinates.
MISSED = 1e-9
#: Places of asked-for documents that are broadcast; more of them meet the documents in a shuffle.
MAX_BROADCAST = 1_000_000
#: Members of a posting list that are compared at once.
BLOCK = 2_048
#: Members of a block of a family, and shingles of their sets.
FAMILY_BLOCK = 4_096
FAMILY_SHINGLES = 800_000

_random = np.random.default_rng(20)
PLACES = _random.integers(0, 2**64, SHINGLE, np.uint64) | np.uint64(1)
FACTORS = _random.integers(0, 2**32, COORDINATES, np.uint32) | np.uint32(1)
SHIFTS = _random.integers(0, 2**32, COORDINATES, np.uint32)


def matches_for(threshold: int) -> int:
    """The most equal coordinates that all but ``MISSED`` of the links at a similarity of ``threshold`` percent have."""
    p, matches = threshold / 100, 0
    below = (1 - p) ** COORDINATES
    while matches < COORDINATES and below <= MISSED:
        matches += 1
        below += comb(COORDINATES, matches) * p**matches * (1 - p) ** (COORDINATES - matches)
    return max(1, matches)


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each text."""
    hashes, _, starts = hash_words(texts, fold=True)
    hashes = hashes[0]
    total = np.zeros(len(hashes), np.uint64)
    for i in range(min(SHINGLE, len(hashes))):
        total[: len(hashes) - i] += hashes[i:] * PLACES[i]
    out = []
    for a, b in zip(starts.tolist(), starts[1:].tolist()):
        if b - a >= SHINGLE:
            own = total[a : b - SHINGLE + 1] + np.uint64(SHINGLE)
        else:  # the whole sequence
            own = (hashes[a:b] * PLACES[: b - a]).sum(keepdims=True) + np.uint64(b - a) if b > a else hashes[a:a]
        out.append(np.unique(mix(own)))
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two checksums and the MinHash values of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    sums = np.stack([np.add.reduceat(mix(flat + np.uint64(seed)), starts) for seed in (1, 2)], 1)
    short = (flat >> np.uint64(32)).astype(np.uint32)
    values = np.stack([np.minimum.reduceat(short * a + b, starts) for a, b in zip(FACTORS, SHIFTS)], 1)
    return sums.view(np.int64), values


def sketch_udf():
    """text -> size of the set, two checksums, signature."""

    @F.arrow_udf("struct<n:bigint,sum1:bigint,sum2:bigint,signature:array<int>>")
    def sketch(texts: pa.Array) -> pa.Array:
        n, sums, sigs = [], [], []
        for at in range(0, len(texts), 250):
            sets = shingle_sets(texts[at : at + 250].cast(pa.binary()).to_pylist())
            full = [s for s in sets if len(s)]
            pair, values = signatures(full) if full else (np.zeros((0, 2), np.int64), np.zeros((0, COORDINATES), np.uint32))
            rows = iter(zip(pair.tolist(), values))
            for s in sets:
                n.append(len(s))
                found = next(rows) if len(s) else ([0, 0], None)
                sums.append(found[0])
                sigs.append(None if found[1] is None else found[1].view(np.int32))
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array([s[0] for s in sums], pa.int64()), pa.array([s[1] for s in sums], pa.int64()), pa.array(sigs, pa.list_(pa.int32()))], names=["n", "sum1", "sum2", "signature"]
        )

    return sketch


def set_udf():
    @F.arrow_udf("binary")
    def sets(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.binary()).to_pylist()
        return pa.array([s.tobytes() for at in range(0, len(raw), 250) for s in shingle_sets(raw[at : at + 250])], pa.binary())

    return sets


def linked_udf(threshold: int):
    @F.arrow_udf("boolean")
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([similar(np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8"), threshold) for a, b in zip(left, right)], pa.bool_())

    return linked


def collide_udf(matches: int):
    """Whether two signatures agree in enough coordinates."""

    @F.arrow_udf("boolean")
    def collide(left: pa.Array, right: pa.Array) -> pa.Array:
        a, b = (x.flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES) for x in (left, right))
        return pa.array((a == b).sum(axis=1) >= matches)

    return collide


def across_udf(matches: int):
    """Members of two parts of a posting list -> pairs of family blocks, with the members whose signatures collide enough across components."""

    @F.arrow_udf("array<struct<a:bigint,b:bigint,reps:array<bigint>>>")
    def across(ids: pa.Array, comps: pa.Array, blocks: pa.Array, sigs: pa.Array, sides: pa.Array) -> pa.Array:
        out = []
        for i, c, k, s, f in zip(ids, comps, blocks, sigs, sides):
            i, c, k, f = (x.values.to_numpy(zero_copy_only=False) for x in (i, c, k, f))
            v = s.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES)
            right = np.flatnonzero(f & 2)
            found: dict[tuple[int, int], set[int]] = {}
            for x in np.flatnonzero(f & 1):
                y = right[c[right] != c[x]]
                y = y[(v[y] == v[x]).sum(axis=1) >= matches]
                own = int(k[x])
                for block in set(k[y].tolist()):
                    met = found.setdefault((min(own, block), max(own, block)), set())
                    met.add(int(i[x]))
                    met.update(i[y[k[y] == block]].tolist())
            out.append([{"a": a, "b": b, "reps": sorted(met)} for (a, b), met in found.items()])
        return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("reps", pa.list_(pa.int64()))])))

    return across


def similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets are linked."""
    if 100 * min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    at = np.searchsorted(x, y)
    both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return 100 * both >= threshold * (len(x) + len(y) - both)


def merge_udf(matches: int, threshold: int):
    """Members of family blocks that meet -> the links between them that join components, confirmed on the full sets."""

    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def merge(tasks: pa.Array) -> pa.Array:
        out = []
        for task in tasks:
            members = {r["rep"]: r for r in sorted(task.as_py(), key=lambda r: r["rep"])}
            ids = list(members)
            v = np.array([members[i]["signature"] for i in ids], np.int32)
            sets = [np.frombuffer(members[i]["set"], "<u8") for i in ids]
            root = {members[i]["comp"]: members[i]["comp"] for i in ids}

            def find(c: int) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            links = []
            for x in range(1, len(ids)):
                agree = (v[:x] == v[x]).sum(axis=1)
                near = np.flatnonzero(agree >= matches)
                for y in near[np.argsort(-agree[near], kind="stable")].tolist():
                    a, b = find(members[ids[x]]["comp"]), find(members[ids[y]]["comp"])
                    if a != b and similar(sets[x], sets[y], threshold):
                        root[max(a, b)] = min(a, b)
                        links.append({"a": min(ids[x], ids[y]), "b": max(ids[x], ids[y])})
            out.append(links)
        return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    return merge


def postings(reps: DataFrame, matches: int) -> DataFrame:
    """(token, rep, size of the token's list): the prefix of each representative that can have a partner."""
    each = reps.select("rep", F.posexplode("signature").alias("coordinate", "value"))
    tokens = each.select("rep", (F.col("value").cast("long") * COORDINATES + F.col("coordinate")).alias("token"))
    shared = tokens.groupBy("token").count().where("count > 1").select("token", F.col("count").alias("size"))
    own = tokens.join(shared, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("size", "token"))).alias("own"))
    # pairs that nobody else has are the rarest and fill the front of the prefix
    prefix = F.slice("own", F.lit(1), F.greatest(F.lit(0), F.size("own") - (matches - 1)))
    return own.where(F.size("own") >= matches).select("rep", F.explode(prefix).alias("p")).select("rep", "p.token", "p.size")


def sets_of(asked: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, set) of the classes ``asked`` for. ``docs``: d, h, text."""
    where = stash(reps.join(asked, "rep", "left_semi").select("rep", "d", "h"))
    places = F.broadcast(where) if where.count() <= MAX_BROADCAST else where  # so that texts need not be shuffled
    return stash(docs.join(places, ["d", "h"]).dropDuplicates(["rep"]).select("rep", set_udf()("text").alias("set")))


def confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of classes that are linked on their full sets."""
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), reps, docs)
    both = pairs.join(sets.withColumnsRenamed({"rep": "a", "set": "x"}), "a").join(sets.withColumnsRenamed({"rep": "b", "set": "y"}), "b")
    return stash(both.where(linked_udf(threshold)("x", "y")).select("a", "b"))


def family_blocks(lists: DataFrame, star: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, block): families meet the same smallest id in their lists; large ones are split into blocks of bounded size."""
    centres = star.groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("family"))
    member = lists.select("rep").distinct().join(centres, "rep", "left").withColumn("family", F.coalesce("family", "rep")).join(reps.select("rep", "n"), "rep")
    sizes = member.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / FAMILY_BLOCK, F.sum("n") / FAMILY_SHINGLES)).cast("int").alias("blocks"))
    return stash(member.join(sizes, "family").select("rep", F.xxhash64("family", F.pmod(F.xxhash64("rep"), F.col("blocks"))).alias("block")))


def components(links: DataFrame) -> DataFrame:
    """(rep, comp) for every end of a link: the smallest id that is reachable."""
    both = stash(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stash(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("rep"), F.least("a", "b").alias("comp")))
    while True:
        near = both.join(labels.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "rep").select("rep", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("rep").alias("comp"), F.col("comp").alias("far"))
        new = stash(lower.join(jump, "comp", "left").select("rep", "was", F.least("comp", F.coalesce("far", "comp")).alias("comp")))
        labels = new.select("rep", "comp")
        if new.where("was <> comp").isEmpty():
            return labels


def classified(docs: DataFrame, doc_id: str, text: str, threshold: int, matches: int) -> DataFrame:
    """Per row: doc_id, d (id as number), h (hash of the text), n (size of the set), comp (smallest id of the component)."""
    named = docs.select(F.col(doc_id).alias("doc_id"), id_order(doc_id).alias("d"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    sketched = stash(named.select("doc_id", "d", "h", sketch_udf()("text").alias("k")).select("doc_id", "d", "h", "k.*"))
    # a class is a size and two checksums; it gets a number of its own, and its representative is known by id and text
    classes = sketched.where("n > 0").groupBy("n", "sum1", "sum2").agg(F.min(F.struct("d", "h")).alias("r"), F.first("signature").alias("signature"))
    reps = stash(classes.select(F.monotonically_increasing_id().alias("rep"), "n", "sum1", "sum2", "r.*", "signature"))
    lists = stash(postings(reps, matches))
    sigs, texts = reps.select("rep", "signature"), named.select("d", "h", "text")

    centre = lists.groupBy("token").agg(F.min("rep").alias("a"))
    star = stash(lists.join(centre, "token").where("a <> rep").select("a", F.col("rep").alias("b")).distinct())
    met = star.join(sigs.withColumnsRenamed({"rep": "a", "signature": "x"}), "a").join(sigs.withColumnsRenamed({"rep": "b", "signature": "y"}), "b")
    links = confirm(stash(met.where(collide_udf(matches)("x", "y")).select("a", "b")), reps, texts, threshold)

    blocks = family_blocks(lists, star, reps)
    standing = stash(blocks.join(components(links), "rep", "left").withColumn("comp", F.coalesce("comp", "rep")).join(sigs, "rep"))
    member = stash(lists.join(standing.select("rep", "comp"), "rep"))
    open_lists = member.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("members")).where("low < high").select("token", "members")
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    dealt = (
        member.drop("comp")
        .join(open_lists, "token")
        .join(standing, "rep")
        .withColumn("parts", F.ceil(F.col("members") / BLOCK).cast("int"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "comp", "block", "signature", F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
    )
    met_again = dealt.groupBy("token", "i", "j").agg(F.collect_list(F.struct("rep", "comp", "block", "signature", "side")).alias("m")).where(F.size("m") > 1)
    across = stash(met_again.select(across_udf(matches)("m.rep", "m.comp", "m.block", "m.signature", "m.side").alias("pairs")))
    met = across.select(F.explode("pairs").alias("p")).select(F.struct("p.a", "p.b").alias("task"), F.explode("p.reps").alias("rep")).distinct()
    tasks = stash(met)
    full = standing.join(sets_of(tasks.select("rep").distinct(), reps, texts), "rep")
    gathered = tasks.join(full, "rep").groupBy("task").agg(F.collect_list(F.struct("rep", "comp", "signature", "set")).alias("m"))
    merged = stash(gathered.select(merge_udf(matches, threshold)("m").alias("links")))
    links = links.unionByName(merged.select(F.explode("links").alias("p")).select("p.a", "p.b"))

    labelled = stash(reps.join(components(links), "rep", "left").select("n", "sum1", "sum2", "d", F.coalesce("comp", "rep").alias("comp")))
    smallest = labelled.groupBy("comp").agg(F.min("d").alias("least"))
    classes = labelled.join(smallest, "comp").select("n", "sum1", "sum2", "least")
    return sketched.drop("signature").join(classes, ["n", "sum1", "sum2"], "left").select("doc_id", "d", "h", "n", F.coalesce("least", "d").alias("comp"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    back = F.when(F.col("comp") != LOWEST_ID, F.col("comp"))
    return classified(docs, doc_id, text, threshold, matches_for(threshold)).select("doc_id", F.col("n").alias("n_shingles"), back.alias("component_id"), (F.col("d") == F.col("comp")).alias("kept"))


def keep_first(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One document of each component, the one with the smallest id, with its own columns (of rows with equal id and text, one)."""
    found = classified(docs, doc_id, text, threshold, matches_for(threshold)).where("d = comp")
    d, h = fresh(docs, "_d"), fresh(docs, "_h")
    chosen = found.groupBy("d", "h").count().withColumnsRenamed({"d": d, "h": h})
    keyed = docs.withColumn(d, id_order(doc_id)).withColumn(h, F.xxhash64(text))
    kept = keyed.join(chosen.drop("count"), [d, h], "left_semi")
    if not chosen.where("count > 1").isEmpty():
        kept = kept.dropDuplicates([d, h])
    return kept.select(*docs.columns)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
