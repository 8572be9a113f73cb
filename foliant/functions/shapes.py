"""Page shapes: catalog, grid geometry, prices, and the shape for a reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The catalog of variants (variant, font, cell width, cell height, stretch, ink, dim stopwords, columns, repeat, page edge).
CATALOG = [
    ("8x8u-bw", "8x8", 8, 8, True, "bw", False, 1, 1, 1568),
    ("8x8u-sent", "8x8", 8, 8, True, "sent", False, 1, 1, 1568),
    ("8x8r-bw", "8x8", 8, 8, True, "bw", False, 1, 2, 1568),
    ("8x8r-sent", "8x8", 8, 8, True, "sent", False, 1, 2, 1568),
    ("6x6u-bw", "8x8", 6, 6, True, "bw", False, 1, 1, 1568),
    ("6x6u-sent", "8x8", 6, 6, True, "sent", False, 1, 1, 1568),
    ("5x8-bw", "5x8", 5, 8, True, "bw", False, 1, 1, 2576),
    ("5x8-sent", "5x8", 5, 8, True, "sent", False, 1, 1, 2576),
    ("6x12-dim", "6x12", 6, 12, True, "bw", True, 1, 1, 1568),
    ("8x13-bw", "8x13", 8, 13, True, "bw", False, 1, 1, 1568),
    ("8on16-bw", "8x13", 8, 16, False, "bw", False, 1, 1, 1568),
    ("8on22-bw", "8x13", 8, 22, False, "bw", False, 1, 1, 1568),
    ("11on16-bw", "8x13", 11, 16, False, "bw", False, 1, 1, 1568),
    ("silver16-bw", "silver", 16, 16, True, "bw", False, 1, 1, 1568),
    ("doc-8on16-bw", "8x13", 8, 16, False, "bw", False, 2, 1, 1568),
    ("doc-8on16-sent", "8x13", 8, 16, False, "sent", False, 2, 1, 1568),
    ("doc-8on16-sent-dim", "8x13", 8, 16, False, "sent", True, 2, 1, 1568),
]
FIELDS = "variant string, font string, cell_w int, cell_h int, stretch boolean, ink string, dim_stopwords boolean, columns int, repeat int, frame_size int"
GUTTER = 3
DENSE = "8on16-bw"
# Reader rules, first match wins: pattern, variant, page edge (0: the variant's own).
RULES = [
    ("(?i)claude.*(fable|mythos)", "11on16-bw", 1932),
    (r"(?i)claude.*opus[-.](?:4[-.](?:[7-9]|[1-9]\d)|[5-9]|[1-9]\d)(?!\d)", "11on16-bw", 1932),
    ("(?i)claude", "11on16-bw", 0),
    ("(?i)gemini", "8on22-bw", 2048),
    ("(?i)gpt|codex", "8on22-bw", 0),
    ("(?i)kimi", "8on22-bw", 0),
    ("(?i)glm", "8on16-bw", 0),
]


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, FIELDS)


def grid(df: DataFrame, size: str = "frame_size") -> DataFrame:
    """``df`` of shapes with grid_cols, grid_rows and capacity at page edge ``size``."""
    cols = F.floor(F.col(size) / F.col("cell_w"))
    rows = F.greatest(F.lit(1), F.floor((F.col(size) - F.col("cell_h")) / F.col("cell_h") / F.col("repeat")))
    own = F.when(F.col("columns") == 2, F.floor((cols - GUTTER) / 2)).otherwise(cols)
    return df.withColumns({"grid_cols": own.cast("long"), "grid_rows": rows.cast("long"), "capacity": (F.col("columns") * own * rows).cast("long")})


def family(api: Column) -> Column:
    """Billing family of an API name."""
    starts = lambda *names: F.coalesce(api.rlike(f"^(?:{'|'.join(names)})"), F.lit(False))
    return F.when(starts("anthropic", "bedrock"), "anthropic").when(starts("google"), "google").when(starts("openai", "azure-openai"), "openai").otherwise("unknown")


def frame_tokens(fam: Column, size: Column) -> Column:
    """Tokens billed for a page of this edge."""
    patches = lambda edge, cap: F.least(F.pow(F.ceil(size / edge).cast("double"), 2.0), F.lit(float(cap)))
    return F.when(fam == "google", 1120).when(fam == "openai", F.ceil(patches(32, 10_000) * 12 / 10)).otherwise(F.ceil(patches(28, 4_784) * 105 / 100)).cast("long")


def for_reader(readers: DataFrame) -> DataFrame:
    """Readers (api, model_id, forced) with variant, page edge and family; the small catalog is joined by broadcast."""
    fam, model = family(F.col("api")), F.coalesce("model_id", F.lit(""))
    variant = F.when(fam == "anthropic", "11on16-bw").otherwise("8on22-bw")
    edge = F.lit(0)
    for pattern, name, size in reversed(RULES):
        variant = F.when(model.rlike(pattern), name).otherwise(variant)
        edge = F.when(model.rlike(pattern), size).otherwise(edge)
    known = F.col("forced").isin([c[0] for c in CATALOG])
    picked = readers.withColumns({"family": fam, "variant": F.when(known, F.col("forced")).otherwise(variant), "edge": F.when(known, 0).otherwise(edge)})
    shaped = picked.join(F.broadcast(catalog(readers.sparkSession)), "variant")
    return shaped.withColumn("frame_size", F.when(F.col("edge") > 0, F.col("edge")).otherwise(F.col("frame_size"))).drop("edge")


def with_dense(shaped: DataFrame) -> DataFrame:
    """Shapes with the variant of their dense companion: the dense variant when it holds more, else their own."""
    dense = next(c for c in CATALOG if c[0] == DENSE)
    cols, rows = F.floor(F.col("frame_size") / dense[2]), F.floor((F.col("frame_size") - dense[3]) / dense[3])
    more = (F.col("columns") == 1) & (F.col("font") != "silver") & (cols * rows > F.col("capacity"))
    return grid(shaped).withColumn("dense_variant", F.when(more, DENSE).otherwise(F.col("variant")))


def describe(fam: Column) -> Column:
    """One line about a shape."""
    layout = F.when(F.col("columns") == 2, "two-column").when(F.col("repeat") > 1, F.concat(F.lit("repeat x"), F.col("repeat"))).otherwise("grid")
    dim = F.when(F.col("dim_stopwords"), "+dim").otherwise("")
    tokens = F.format_number(frame_tokens(fam, F.col("frame_size")), 0)
    cells = F.concat(F.col("cell_w"), F.lit("x"), F.col("cell_h"))
    return F.concat(F.col("font"), F.lit(" "), cells, F.lit(" "), layout, F.lit(" @"), F.col("frame_size"), F.lit("px, "), F.col("ink"), dim, F.lit(" ink, ~"), tokens, F.lit(" tok/frame"))
