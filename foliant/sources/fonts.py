"""Bitmap fonts as a table of glyphs (font, cp, w, h, xoff, yoff, rows).

Font files are inputs by path. The hex format is parsed with DataFrame functions, a line a glyph; the
BDF format keeps its state over many lines and so is parsed a file at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "font string, cp int, w int, h int, xoff int, yoff int, rows array<int>"


def read_hex(spark: SparkSession, path: str, font: str) -> DataFrame:
    """``CODE:16 hex digits`` lines as 8x8 glyphs; other lines are skipped, of equal codes the last in order of text wins."""
    line = F.regexp_extract_all("value", F.lit(r"\A([0-9A-Fa-f]{1,6}):([0-9A-Fa-f]{16})\s*\z"), F.lit(1))
    digits = F.regexp_extract("value", r"\A[0-9A-Fa-f]{1,6}:([0-9A-Fa-f]{16})\s*\z", 1)
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    glyphs = spark.read.text(path).where(F.size(line) > 0).select(F.conv(line[0], 16, 10).cast("int").alias("cp"), rows.alias("rows"))
    last = glyphs.groupBy("cp").agg(F.max("rows").alias("rows"))
    return last.select(F.lit(font).alias("font"), "cp", F.lit(8).alias("w"), F.lit(8).alias("h"), F.lit(0).alias("xoff"), F.lit(-1).alias("yoff"), "rows")


def number(word: str, base: int = 10) -> int:
    try:
        return int(word, base)
    except ValueError:
        return 0


def parse_bdf(text: str) -> list[tuple[int, int, int, int, int, list[int]]]:
    """(cp, w, h, xoff, yoff, rows) of a BDF font; of equal codes the last wins."""
    found: dict[int, tuple] = {}
    cp, box, rows = -1, (0, 0, 0, 0), None
    for line in text.splitlines():
        word, *rest = line.split() or [""]
        if word == "ENCODING":
            cp = number(rest[0]) if rest else 0
        elif word == "BBX":
            box = tuple([*map(number, rest), 0, 0, 0, 0][:4])
        elif word == "BITMAP":
            rows = []
        elif word == "ENDCHAR":
            if cp >= 0 and rows is not None:
                found[cp] = (cp, min(max(box[0], 0), 8), box[1], box[2], box[3], rows)
            cp, rows = -1, None
        elif rows is not None and word:
            rows.append(number(word, 16))
    return list(found.values())


def read_bdf(spark: SparkSession, path: str, font: str) -> DataFrame:
    """Glyphs of BDF files, each file parsed whole in a task."""

    def parse(batches):
        import pandas as pd

        for batch in batches:
            glyphs = [(font, *g) for text in batch["value"] for g in parse_bdf(text)]
            yield pd.DataFrame(glyphs, columns=["font", "cp", "w", "h", "xoff", "yoff", "rows"])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, FIELDS)


def coverage(glyphs: DataFrame) -> DataFrame:
    """(font, bucket, bitmap) of the code points of each font: 32,768 to a bitmap, so a font is a few rows however many glyphs it has."""
    place = F.col("cp").cast("long") + 1  # buckets of bitmap functions start at one
    return glyphs.where("cp >= 0").groupBy("font", F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))


def with_fallback(covered: DataFrame, font: str, fallback: str) -> DataFrame:
    """(bucket, bitmap) of what a font or the one behind it prints."""
    return covered.where(F.col("font").isin(font, fallback)).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def printable(characters: DataFrame, covered: DataFrame) -> DataFrame:
    """``characters`` (ch) with ``printable``: whether a bitmap of ``covered`` (bucket, bitmap) has its code point."""
    place = F.ascii("ch").cast("long") + 1
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bitmap", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    found = characters.withColumn("bucket", F.bitmap_bucket_number(place)).join(covered, "bucket", "left")
    return found.withColumn("printable", F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False))).drop("bucket", "bitmap")


def text_stats(texts: DataFrame, covered: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with ``visible`` and ``lost``: how many characters other than spaces they have, and how many of them no font prints.

    Distinct characters of all texts are looked up once; a text then needs only its own lost ones.
    """
    row = texts.withColumn("chars_", F.array_except(F.array_distinct(F.split(F.coalesce(F.col(text), F.lit("")), "")), F.array(F.lit(""), F.lit(" "))))
    seen = row.select(F.explode("chars_").alias("ch")).distinct()
    gone = printable(seen, covered).where("not printable").agg(F.collect_set("ch").alias("gone_"))  # bounded by the number of code points
    counted = row.crossJoin(F.broadcast(gone)).withColumn("own_", F.array_join(F.array_intersect("chars_", "gone_"), ""))
    solid = F.translate(F.coalesce(F.col(text), F.lit("")), " ", "")
    left = F.call_function("translate", solid, F.col("own_"), F.lit(""))
    return counted.withColumns({"visible": F.length(solid).cast("long"), "lost": (F.length(solid) - F.length(left)).cast("long")}).drop("chars_", "gone_", "own_")
