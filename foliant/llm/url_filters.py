"""URL filters: a blocked Bloom filter in front of an exact hash join.

Two tables hold canonical URL prefixes, ``host/path`` without scheme, each with a verdict: rules, and
a list that is asked only where no rule fits. An entry fits its host and all subdomains when the path
starts with the entry's path. Each URL yields its possible keys (its host and parent domains, each
with its path cut to the lengths that the entries have). A blocked Bloom filter of all entries drops
keys that are certainly in neither table: one 256-bit block a key, eight bits set in it. The rest,
hits and false positives, meet the entries in an exact hash join, which removes the false positives;
the longest rule that fits decides, else the longest listed entry.

The filter takes ``BITS`` bits a key up to ``MAX_FILTER_BYTES``; beyond that it only lets more false
positives through to the join. Its blocks are built by a Spark aggregation (bits combine before the
shuffle) and only they are sent to the driver and broadcast. Equal URLs are judged once and counted,
so a very frequent URL is one row; the join broadcasts the list only up to ``MAX_BROADCAST_ROWS``
entries and otherwise salts its keys.

Defined cases: a null URL or one without ``://`` has an empty host and path and no rule, and is
allowed; repeated rows each get their row; with no entry at all everything is allowed; repeated
entries count once, a rule before a listed entry, then a block before an allow; entries with a null
key do not count; other columns of the pages are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import stash, table

#: The rules that every URL is judged by.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Sites that the query lists under each of these domains.
SITES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
DOMAINS = ["example.com", "example.net", "example.org"]
BITS = 16
MAX_FILTER_BYTES = 64 << 20
MAX_BROADCAST_ROWS = 100_000
SALTS = 32
WORDS = 4  # 64-bit words of a block
PROBES = 8


def split_url(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, lower).otherwise(""), F.when(has, path).otherwise("")


def canonical(rules: DataFrame, listed: DataFrame | None) -> DataFrame:
    """(key, fixed, verdict) with one row a key; ``fixed``: it is a rule."""
    entries = rules.select("key", F.lit(True).alias("fixed"), "verdict")
    if listed is not None:
        entries = entries.unionByName(listed.select("key", F.lit(False).alias("fixed"), "verdict"))
    return entries.where(F.col("key").isNotNull()).groupBy("key").agg(F.max(F.struct("fixed", "verdict")).alias("e")).select("key", "e.*")


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """Possible list keys of a URL: every domain suffix with every listed path length that the path has."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    pairs = F.transform(domains, lambda d: F.transform(cuts, lambda n: F.concat(d, F.substring(path, F.lit(1), n))))
    return F.when(host != "", F.flatten(pairs)).otherwise(F.array().cast("array<string>"))


def block_of(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 20), F.lit(blocks)).cast("long")


def bloom(listed: DataFrame, blocks: int) -> np.ndarray:
    """The filter's words, blocks x WORDS: bits are combined by a Spark aggregation."""
    h = F.xxhash64("key")
    bits = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: F.shiftrightunsigned(F.xxhash64(h, i), 56)))
    set_bits = listed.select(block_of(h, blocks).alias("block"), F.explode(bits).alias("bit")).groupBy("block", F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")
    )
    words = np.zeros((blocks, WORDS), np.uint64)
    for block, word, value in set_bits.toLocalIterator():  # as many words as the filter has, at most
        words[block, word] = value & 0xFFFFFFFFFFFFFFFF
    return words


def probe_udf(spark: SparkSession, words: np.ndarray):
    """Possible keys, their blocks and bits -> the keys that may be listed."""
    sent = spark.sparkContext.broadcast(words)

    @F.arrow_udf("array<string>")
    def probe(keys: pa.Array, blocks: pa.Array, bits: pa.Array) -> pa.Array:
        flat_blocks = blocks.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        flat_bits = bits.flatten().flatten().to_numpy(zero_copy_only=False).astype(np.uint64).reshape(-1, PROBES)
        chosen = sent.value[flat_blocks[:, None], (flat_bits >> np.uint64(6)).astype(np.int64)] if len(flat_blocks) else np.zeros((0, PROBES), np.uint64)
        may = ((chosen >> (flat_bits & np.uint64(63))) & np.uint64(1)).all(axis=1)
        out, at = [], 0
        for row in keys.to_pylist():
            out.append([k for k, yes in zip(row, may[at : at + len(row)]) if yes])
            at += len(row)
        return pa.array(out, pa.list_(pa.string()))

    return probe


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, *, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, host, path, rule, verdict, listed for every page. ``rules``, ``listed``: columns key (``host/path``) and verdict."""
    spark = pages.sparkSession
    listed = stash(canonical(rules, listed))
    n = listed.count()
    path_length = F.length("key") - F.instr("key", "/") + 1
    lengths = sorted(r[0] for r in listed.select(path_length).distinct().collect())  # path lengths, not entries
    blocks = max(1, min(n * BITS // 256 + 1, MAX_FILTER_BYTES // (8 * WORDS)))
    words = bloom(listed, blocks)

    host, path = split_url(F.col(url))
    urls = pages.groupBy(F.col(page_id).alias("page_id"), F.col(url).alias("url")).agg(F.count("*").alias("copies"))
    split = urls.withColumn("host", host).withColumn("path", path).withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths))
    hashes = F.transform("keys", lambda k: F.xxhash64(k))
    bits = lambda h: F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: F.shiftrightunsigned(F.xxhash64(h, i), 56))
    # written, because Spark does not extract a Python function whose arguments hold lambdas
    hashed = stash(split.select("*", F.transform(hashes, lambda h: block_of(h, blocks)).alias("blocks"), F.transform(hashes, bits).alias("bits")))
    probed = hashed.select("page_id", "url", "host", "path", "copies", probe_udf(spark, words)("keys", "blocks", "bits").alias("hits"))
    maybe = probed.select("page_id", "url", "host", "path", "copies", F.explode_outer("hits").alias("key"))
    if n <= MAX_BROADCAST_ROWS:
        joined = maybe.join(F.broadcast(listed), "key", "left")
    else:
        salted = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = maybe.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left")
    found = F.when(F.col("verdict").isNotNull(), F.struct("fixed", F.length("key").alias("n"), "key", "verdict"))
    best = joined.groupBy("page_id", "url", "host", "path", "copies").agg(F.max(found).alias("best"))
    return best.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "page_id", "url", "host", "path", F.when(F.col("best.fixed"), F.col("best.key")).alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"), F.when(~F.col("best.fixed"), F.col("best.key")).alias("listed")
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "key string, verdict string")
    listed = spark.createDataFrame([(f"{site}.{domain}/", "block") for site in SITES for domain in DOMAINS], "key string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules, listed).drop("url")


ORACLE = """
WITH u AS (
  SELECT page_id, url, coalesce(contains(url, '://'), false) AS has, url[strpos(url, '://') + 3:] AS rest FROM pages
), s AS (
  SELECT page_id, CASE WHEN has THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN has THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
         row_number() OVER () AS n
  FROM u
), r(entry, fixed, verdict) AS (
  VALUES ('net/', true, 'block'), ('example.net/en/', true, 'allow'), ('example.com/de/', true, 'block'), ('org/fr/', true, 'allow')
  UNION ALL
  SELECT site || '.' || domain || '/', false, 'block'
  FROM (VALUES ('ads-track'), ('adult-x'), ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm')) x(site), (VALUES ('example.com'), ('example.net'), ('example.org')) y(domain)
), e AS (SELECT entry, fixed, verdict, split_part(entry, '/', 1) AS h, entry[strpos(entry, '/'):] AS p FROM r),
m AS (
  SELECT s.n, e.entry, e.fixed, e.verdict, row_number() OVER (PARTITION BY s.n ORDER BY e.fixed DESC, length(e.entry) DESC) AS k
  FROM s JOIN e ON (s.host = e.h OR ends_with(s.host, '.' || e.h)) AND starts_with(s.path, e.p)
)
SELECT s.page_id, s.host, s.path, CASE WHEN m.fixed THEN m.entry END AS rule, coalesce(m.verdict, 'allow') AS verdict, CASE WHEN NOT m.fixed THEN m.entry END AS listed
FROM s LEFT JOIN m ON s.n = m.n AND m.k = 1
"""
