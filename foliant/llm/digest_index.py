"""Exact deduplication against a persistent index of digests.

The index is a table in the shared folder with one row for each digest that any batch brought in: partitioned by
batch, bucketed and sorted by digest. A batch is deduplicated in three steps: its rows are first aggregated by
digest (partly before the shuffle, so a text that fills a third of the batch is a handful of rows), a sort-merge
anti-join drops the digests that the index has, and the rest are appended as the batch's partition. The anti-join
reads the index by its buckets and never shuffles it. Writing a batch again replaces its partition, so a job that died
may be repeated.

Verdicts go back to the rows by a join whose other side has one row a digest; adaptive execution splits a hot digest.

Defined cases: a null text is an empty one; the first row of a digest is the one with the smallest id, a null id before
all others, and of rows with one id exactly one; an empty batch appends nothing; an earlier batch keeps its row
whatever the ids of later ones; other columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import exists, fresh, remove, shared_dir, stash, table

#: Bytes that count as white space.
WHITE = r"[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    """The text with every run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalized text, as 32 bytes."""
    return F.unhex(F.sha2(normalized(text).cast("binary"), 256))


class DigestIndex:
    """The index below ``path``; opening a new path creates it with ``buckets`` buckets (default: the shuffle partitions)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, id_type: str = "bigint"):
        self.spark, self.path = spark, path.rstrip("/")
        if not exists(spark, f"{self.path}/about/_SUCCESS"):
            buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.createDataFrame([(buckets, id_type)], "buckets int, id_type string").write.mode("overwrite").parquet(f"{self.path}/about")
        about = spark.read.parquet(f"{self.path}/about").first()
        self.buckets = about["buckets"]
        (name,) = spark.range(1).select(F.sha2(F.lit(self.path), 256)).first()
        self.name = f"digests_{name[:16]}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id {about['id_type']}, keep_row BIGINT, batch STRING) USING parquet "
            f"PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/digests'"
        )
        if exists(spark, f"{self.path}/digests"):  # batches of earlier sessions
            spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame, batch: str) -> None:
        """Add the digests of ``rows`` (digest, id, row) that no other batch has."""
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (batch = '{batch}')")
        remove(self.spark, f"{self.path}/digests/batch={batch}")
        firsts = rows.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("first"))
        new = firsts.join(self.entries().hint("merge"), "digest", "left_anti").select("digest", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"))
        # one task a bucket: the join is dealt by the buckets already, so this moves nothing
        new.repartition(self.buckets, "digest").withColumn("batch", F.lit(batch)).write.insertInto(self.name)

    def judge(self, rows: DataFrame) -> DataFrame:
        """A row for each digest of ``rows``: which row keeps it, and how many of ``rows`` have it."""
        sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
        return sizes.join(self.entries().drop("batch").hint("merge"), "digest")


def dedup_exact(docs: DataFrame, index: DigestIndex, batches: list[tuple[str, Column]], *, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, out: str = "copies") -> tuple[DataFrame, str]:
    """The ``carry`` columns (default: all) with a struct (digest, keep_id, group_size, kept) in a new column; returns its name too.

    ``batches`` are (name, condition on the column ``id``) and are appended in order; each row belongs to one of them.
    """
    out = fresh(docs, out)
    rows = stash(docs.select(F.struct(*(carry or docs.columns)).alias("carried"), F.col(doc_id).alias("id"), F.monotonically_increasing_id().alias("row"), digest(F.col(text)).alias("digest")))
    for name, condition in batches:
        index.append(rows.where(condition), name)
    verdicts = stash(index.judge(rows))
    joined = rows.join(verdicts, "digest")
    return joined.select("carried.*", F.struct("digest", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept")).alias(out)), out


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower half of the ids is the history, the upper half new data; an id is in one half, so the smallest id stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    history = F.col("id").isNull() | (F.col("id") <= F.lit(middle))
    found, out = dedup_exact(docs, DigestIndex(spark, shared_dir(spark)), [("history", history), ("new", ~F.coalesce(history, F.lit(True)))], carry=["doc_id"])
    c = F.col(out)
    return found.select("doc_id", c["keep_id"].alias("keep_id"), c["group_size"].alias("group_size"), c["kept"].alias("kept"), F.lower(F.hex(c["digest"])).alias("text_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
