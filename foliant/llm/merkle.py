"""A Merkle manifest: one digest for a dataset, and for every row the siblings that prove it belongs to it.

Nodes of a group (all rows of a language; then the languages' subroots) stand in a fixed order, and level by level every
two consecutive ones become their hash, a last lone one alone, until one remains.

A group is cut into aligned blocks of ``2 ** HEIGHT`` nodes. A task walks a block's tree in postorder: the walk returns a
subtree's digest and, while it unwinds, appends to the leaves of each half the other half's digest. The block roots are
the nodes of the next distributed walk, until every group has one node; then each node takes over the siblings of its
block. A block is small whatever the size of its group, and no group or list of all nodes is ever gathered.

Places in a group come from sorting by ranges: each task numbers its own rows, and sums of the tasks' counts, a row for
each task and group, shift them.

Defined cases: null, as a field or a leaf's digest, is written as ``-`` and orders first; rows of equal order and digest have interchangeable places; an
empty table has no rows and no root; other columns are carried along, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import stash, table

#: Levels of the tree that one task walks at once; a block has two to the power of this many nodes.
HEIGHT = 8


def field(c: Column) -> Column:
    """A value with the number of its bytes before it, so that no two rows are written alike."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def walk(nodes: list[str], height: int) -> tuple[str, list[list[str | None]]]:
    """Root of a block and, for every node, its sibling on each level (None where it has none)."""
    siblings: list[list[str | None]] = [[] for _ in nodes]

    def subtree(start: int, level: int) -> str:
        if level == 0:
            return nodes[start]
        middle, end = start + (1 << level - 1), min(start + (1 << level), len(nodes))
        left = subtree(start, level - 1)
        right = subtree(middle, level - 1) if middle < end else None
        for leaf in range(start, min(middle, end)):
            siblings[leaf].append(right)
        for leaf in range(middle, end):
            siblings[leaf].append(left)
        return hashlib.sha256((left + (right or "")).encode()).hexdigest()

    return subtree(0, height), siblings


def block_walker(height: int):
    def walk_block(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        size = rows["size"][0].as_py()
        root, siblings = walk(rows["digest"].to_pylist(), height if size > 1 << height else (size - 1).bit_length())
        return rows.select(["grp", "pos", "block", "size"]).append_column("siblings", pa.array(siblings, pa.list_(pa.string()))).append_column("block_root", pa.array([root] * len(rows), pa.string()))

    return walk_block


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with their place in their group (``pos``, by ``order``) and the group's ``size``."""
    keys = ["grp", *order]
    ranged = nodes.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*keys, "salt").sortWithinPartitions(*keys, "salt")
    seen = stash(ranged.drop("salt").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    counts = seen.groupBy("part", "grp").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    by_group = Window.partitionBy("grp")
    shifts = counts.select("part", "grp", (F.coalesce(F.sum("n").over(by_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(by_group).alias("size"))
    same = (F.col("a.part") == F.col("b.part")) & F.col("a.grp").eqNullSafe(F.col("b.grp"))
    return seen.alias("a").join(shifts.alias("b"), same).select("a.*", (F.col("at") + F.col("shift")).alias("pos"), "size").drop("part", "at")


def climb(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``nodes`` (grp, pos, size, digest) -> grp, pos, siblings from the lowest level up, and the group's root."""
    levels, lowest = [], nodes
    while True:
        blocks = lowest.select("grp", "pos", "size", "digest", (F.shiftright("pos", height)).alias("block"))
        walked = stash(blocks.groupBy("grp", "block").applyInArrow(block_walker(height), f"grp {nodes.schema['grp'].dataType.simpleString()}, pos long, block long, size long, siblings array<string>, block_root string"))
        levels.append(walked)
        if walked.where("block > 0").isEmpty():
            break
        first = walked.where(F.col("pos") == F.shiftleft("block", height))
        lowest = first.select("grp", F.col("block").alias("pos"), F.ceil(F.col("size") / (1 << height)).alias("size"), F.col("block_root").alias("digest"))

    def under(upper: DataFrame, lower: DataFrame) -> DataFrame:
        same = (F.col("a.block") == F.col("b.pos")) & F.col("a.grp").eqNullSafe(F.col("b.grp"))
        return lower.alias("a").join(upper.alias("b"), same).select("a.grp", "a.pos", "a.block", F.concat("a.siblings", "b.siblings").alias("siblings"), "b.block_root")

    return reduce(under, reversed(levels)).select("grp", "pos", "siblings", F.col("block_root").alias("root"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path, an array of structs (sibling, whether it stands on the left)."""
    step = lambda acc, s: F.when(s["sibling"].isNull(), digest(acc)).when(s["left"], digest(s["sibling"], acc)).otherwise(digest(acc, s["sibling"]))
    return F.aggregate(path, leaf, step)


def path_of(siblings: Column, pos: Column) -> Column:
    return F.transform(siblings, lambda s, level: F.struct(s.alias("sibling"), (F.getbit(pos, level) == 1).alias("left")))


def manifest(leaves: DataFrame, *, group: str, order: list[str], leaf: str = "leaf", height: int = HEIGHT) -> DataFrame:
    """``leaves`` with ``subroot``, ``root`` and ``path`` (siblings from the leaf's level to the root's, with their sides).

    ``leaves`` are small rows: digests and keys, not texts.
    """
    inner = leaves.select(F.struct(*leaves.columns).alias("carried"), F.col(group).alias("grp"), *(F.col(c).alias(f"key{i}") for i, c in enumerate(order)), F.coalesce(F.col(leaf), F.lit("-")).alias("digest"))
    rows = stash(placed(inner, [f"key{i}" for i in range(len(order))] + ["digest"]))
    below = stash(climb(rows, height))
    tops = below.where("pos = 0").select(F.col("grp").alias("key"), F.lit(0).alias("grp"), F.col("root").alias("digest"))
    tops = stash(placed(tops, ["key"]))
    above = climb(tops, height).alias("a").join(tops.alias("b"), "pos").select("b.key", "pos", F.col("a.siblings").alias("siblings"), F.col("a.root").alias("root"))
    paths = below.alias("a").join(above.alias("b"), F.col("a.grp").eqNullSafe(F.col("b.key"))).select("a.grp", "a.pos", F.col("a.root").alias("subroot"), F.col("b.root").alias("root"), F.concat(path_of(F.col("a.siblings"), F.col("a.pos")), path_of(F.col("b.siblings"), F.col("b.pos"))).alias("path"))
    same = (F.col("r.pos") == F.col("p.pos")) & F.col("r.grp").eqNullSafe(F.col("p.grp"))
    return rows.alias("r").join(paths.alias("p"), same).select("r.carried.*", "p.subroot", "p.root", "p.path")


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    row = lambda **other: digest(*(field(other.get(c, F.col(c))) for c in FIELDS))
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = stash(docs.select("doc_id", "lang", row().alias("leaf"), F.when(altered, row(n_chars=F.col("n_chars") + 1)).alias("tampered")))
    found = manifest(leaves, group="lang", order=["doc_id"])
    proof = F.sha2(F.array_join(F.transform("path", lambda s: s["sibling"]), "").cast("binary"), 256)
    folded = found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The unsigned crc32 of the decimal id, bit by bit.
CRC = """xor(4294967295, list_reduce(
  list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), range(8)), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))))"""


def sized(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS BIGINT) AS pos, count(*) OVER (PARTITION BY lang) AS size FROM (
    SELECT doc_id, lang, sha256(concat({sized('doc_id')}, {sized('source')}, {sized('lang')}, {sized('n_chars')}, {sized('text')})) AS leaf,
      CASE WHEN {CRC} % 7 = 0 THEN sha256(concat({sized('doc_id')}, {sized('source')}, {sized('lang')}, {sized('n_chars + 1')}, {sized('text')})) END AS tampered FROM documents)),
tree AS (
  SELECT lang, 0 AS level, pos, leaf AS digest, size FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (size + 1) // 2 FROM tree WHERE size > 1 GROUP BY lang, level, pos // 2, size),
tops AS (SELECT lang, digest AS subroot, level AS height, CAST(row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS BIGINT) AS pos, count(*) OVER () AS size FROM tree WHERE size = 1),
crown AS (
  SELECT 0 AS level, pos, subroot AS digest, size FROM tops
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (size + 1) // 2 FROM crown WHERE size > 1 GROUP BY level, pos // 2, size),
top AS (SELECT digest AS root, level AS height FROM crown WHERE size = 1),
steps AS (
  SELECT l.doc_id, l.leaf, l.pos AS place, l.lang, g.level, l.pos >> g.level AS pos, s.digest AS sibling
  FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang JOIN range(64) g(level) ON g.level < t.height
  LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = g.level AND s.pos = xor(l.pos >> g.level, 1)
  UNION ALL
  SELECT l.doc_id, l.leaf, l.pos, l.lang, t.height + g.level, t.pos >> g.level, s.digest
  FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang CROSS JOIN top JOIN range(64) g(level) ON g.level < top.height
  LEFT JOIN crown s ON s.level = g.level AND s.pos = xor(t.pos >> g.level, 1)),
paths AS (SELECT lang, place, list(struct_pack(sibling := sibling, on_left := pos % 2 = 1) ORDER BY level) AS path FROM steps GROUP BY lang, place),
folded AS (
  SELECT l.lang, l.pos, coalesce(tampered, leaf) AS acc, 0 AS level, coalesce(path, []) AS path FROM leaves l LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM l.lang AND p.place = l.pos
  UNION ALL
  SELECT lang, pos, sha256(CASE WHEN path[level + 1].on_left THEN concat(path[level + 1].sibling, acc) ELSE concat(acc, path[level + 1].sibling) END), level + 1, path FROM folded WHERE level < len(path))
SELECT l.doc_id, l.leaf, t.subroot, top.root, sha256(coalesce(array_to_string(list_transform(f.path, lambda s: s.sibling), ''), '')) AS proof_sha256, f.acc AS folded_root, f.acc = top.root AS verified
FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang CROSS JOIN top JOIN folded f ON f.lang IS NOT DISTINCT FROM l.lang AND f.pos = l.pos AND f.level = len(f.path)
"""
