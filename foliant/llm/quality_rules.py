"""Quality rules: statistics of each text, fixed limits, and robust multivariate outliers.

Every whole text gets its counts (words, symbols, repeated lines and 3-word windows). Documents that
pass the fixed limits are then judged within their language and source: the minimum covariance
determinant (MCD) estimates centre and spread of their transformed statistics, and a document whose
Mahalanobis distance exceeds the cutoff is rejected.

The MCD runs as Spark aggregations over all rows, for all groups at once: own groups (language and
source), languages, and all rows. From two fixed starts (medians with absolute deviations, and plain
means with covariances; deterministic MCD) concentration steps keep the ``CORE`` share of a group's
rows that are closest and re-estimate mean and covariance from them, until no determinant falls any
more; the start with the smaller determinant wins. Distances are made consistent with the chi-squared
distribution at the same share. An own group's covariance is drawn towards that of its language, and a
language's towards that of all rows, the more the fewer rows it has (``n / (n + SHRINK)`` is its own).
A group whose core has no more rows than dimensions has no MCD; its language's estimates stand in, and
for such a language those of all rows.

Group sums combine before the shuffle, and rows meet the tables of estimates, one row a group, in
broadcast joins up to ``MAX_BROADCAST_GROUPS`` groups and beyond it in joins that adaptive execution
splits, so a hot source is no bottleneck.

Defined cases: a null text has no words and fails the fixed limits; null languages and sources are
groups of their own; a group without spread gets a floor on its variances; repeated rows are judged
one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import fresh, stash, table

MIN_WORDS = 50
#: Rows at which a covariance is half the group's own and half that of the level above.
SHRINK = 50
CORE = 0.75
#: Concentration steps at most, and the fall of a log determinant that asks for another one.
MAX_STEPS, FALL = 10, 1e-3
#: Least standard deviation of each transformed statistic, in the order of DIMS.
FLOORS = [0.03, 0.03, 0.03, 0.08, 0.08]
#: The 0.99999 quantile of chi-squared with 5 degrees of freedom: squared distances beyond it are outliers.
CUTOFF = 30.856
#: Quantile of chi-squared with 5 degrees of freedom at CORE.
CHI2_CORE = 6.626
MAX_BROADCAST_GROUPS = 10_000
DIMS = ["x_length", "x_upper", "x_symbols", "x_lines", "x_repeat"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Key of the estimates of all rows; keys of languages start with "l", those of own groups with a separator or "=".
ALL = ""
STARTS = (0, 1)
WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
UPPER = bytes(range(65, 91))


def repeated(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    if len(seen) < 1 << 21:
        keys = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
        _, where, count = np.unique(keys, return_inverse=True, return_counts=True)
    else:
        _, where, count = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True, return_counts=True)
    twice = count[where.reshape(-1)] > 1
    hit = np.zeros(n, bool)
    for shift in range(3):
        hit[shift : n - 2 + shift] |= twice
    return int(hit.sum())


def counts(raw: bytes | None) -> tuple[int, ...]:
    if not raw:
        return 0, 0, 0, 0, 0, 0
    words = raw.split()
    solid = raw.translate(None, WHITE)
    lines, seen, again = raw.split(b"\n"), set(), 0
    for line in lines:
        if line in seen:
            again += bool(line.strip())
        else:
            seen.add(line)
    return (
        len(words),
        len(solid.translate(None, CONTINUATION)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        again,
        repeated(words),
        len(raw) - len(raw.translate(None, UPPER)),
    )


ALL_COUNTS = [*COUNTS, "n_upper", "n_lines"]


def counts_udf():
    @F.arrow_udf("struct<" + ",".join(f"{x}:bigint" for x in ALL_COUNTS) + ">")
    def count(texts: pa.Array) -> pa.Array:
        rows = [(*counts(x), x.count(b"\n") + 1 if x else 0) for x in texts.cast(pa.binary()).to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(ALL_COUNTS))], names=ALL_COUNTS)

    return count


def inverse_udf():
    @F.arrow_udf("struct<inverse:array<double>,log_det:double>")
    def invert(cov: pa.Array) -> pa.Array:
        """Inverse and log determinant of covariance matrices in row order, with floored variances."""
        inverses, dets = [], []
        for flat in cov.to_pylist():
            m = np.array([x or 0.0 for x in flat]).reshape(len(DIMS), -1) + np.diag(FLOORS) ** 2
            inverses.append(np.linalg.inv(m).reshape(-1).tolist())
            dets.append(float(np.linalg.slogdet(m)[1]))
        return pa.StructArray.from_arrays([pa.array(inverses, pa.list_(pa.float64())), pa.array(dets, pa.float64())], names=["inverse", "log_det"])

    return invert


def distance(e: str) -> Column:
    """Squared Mahalanobis distance of a row to the mean and inverse of the struct ``e``."""
    off = [F.col(x) - F.col(f"{e}.mean")[i] for i, x in enumerate(DIMS)]
    return sum(off[i] * off[j] * F.col(f"{e}.inverse")[i * len(DIMS) + j] for i in range(len(DIMS)) for j in range(len(DIMS)))


def moments(where: Column | None = None) -> Column:
    """Mean and covariance of the rows, or of those that satisfy ``where``."""
    only = lambda x: F.col(x) if where is None else F.when(where, F.col(x))
    return F.struct(F.array(*[F.avg(only(x)) for x in DIMS]).alias("mean"), F.array(*[F.covar_pop(only(x), only(y)) for x in DIMS for y in DIMS]).alias("cov"))


def inverted(estimates: DataFrame, columns: list[str]) -> DataFrame:
    """Each struct (mean, cov) with inverse and log_det."""
    found = estimates.select("*", *[inverse_udf()(F.col(e)["cov"]).alias(f"{e}_i") for e in columns])
    return stash(found.select(*[c for c in estimates.columns if c not in columns], *[F.struct(f"{e}.mean", f"{e}.cov", f"{e}_i.inverse", f"{e}_i.log_det").alias(e) for e in columns]))


def mcd(rows: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """g, n, e (mean, cov, inverse, log_det) for every value of ``g`` in ``rows``; ``small`` marks tables with a row a group."""
    half = lambda x: F.percentile_approx(x, 0.5, 10_000)
    halves = rows.groupBy("g").agg(F.count("*").alias("n"), F.array(*[half(F.col(x)) for x in DIMS]).alias("mid"), moments().alias("e1"))
    halves = stash(halves.where(CORE * F.col("n") > len(DIMS)))
    away = [half(F.abs(F.col(x) - F.col("mid")[i])) for i, x in enumerate(DIMS)]
    spread = rows.join(small(halves.select("g", "mid")), "g").groupBy("g").agg(F.array(*away).alias("away"))
    diagonal = F.array(*[(F.pow(1.4826 * F.col("away")[i], 2) if i == j else F.lit(0.0)) for i in range(len(DIMS)) for j in range(len(DIMS))])
    by_median = F.struct(F.col("mid").alias("mean"), diagonal.alias("cov"))
    names = [f"e{i}" for i in STARTS]
    estimates = inverted(halves.join(small(spread), "g").select("g", "n", by_median.alias("e0"), "e1"), names)
    for step in range(MAX_STEPS):
        far = rows.join(small(estimates.select("g", *names)), "g").select("g", *DIMS, *[distance(e).alias(f"d{e}") for e in names])
        most = far.groupBy("g").agg(*[F.percentile_approx(f"d{e}", CORE, 10_000).alias(f"most{e}") for e in names])
        closest = far.join(small(stash(most)), "g").groupBy("g").agg(*[moments(F.col(f"d{e}") <= F.col(f"most{e}")).alias(e) for e in names])
        before = estimates.select("g", "n", *[F.col(e)["log_det"].alias(f"was{e}") for e in names])
        estimates = inverted(closest.join(small(before), "g"), names)
        falls = [F.col(f"was{e}") - F.col(e)["log_det"] > FALL for e in names]
        if step and estimates.where(falls[0] | falls[1]).isEmpty():
            break
    best = F.when(F.col("e1.log_det") < F.col("e0.log_det"), F.col("e1")).otherwise(F.col("e0"))
    return stash(estimates.select("g", "n", best.alias("e")))


def drawn(cov: Column, above: Column) -> Column:
    """A covariance drawn towards that of the level above; without one it stays."""
    own = F.col("n") / (F.col("n") + SHRINK)
    return F.when(above.isNull(), cov).otherwise(F.zip_with(cov, above, lambda x, y: own * x + (1 - own) * y))


def shrunk(estimates: DataFrame, groups: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """g, e with covariances drawn towards those of the level above. ``groups``: own, of_lang."""
    top = estimates.where(F.col("g") == ALL).select("e.cov").scalar()
    plain = estimates.select("g", "n", "e.mean", "e.cov")
    is_lang = F.startswith("g", F.lit("l"))
    langs = plain.where(is_lang).withColumn("above", top).withColumn("cov", drawn(F.col("cov"), F.col("above"))).drop("above")
    owns = plain.where(~is_lang & (F.col("g") != ALL)).join(small(groups.select(F.col("own").alias("g"), F.col("of_lang"))), "g")
    owns = owns.join(small(langs.select(F.col("g").alias("of_lang"), F.col("cov").alias("above"))), "of_lang", "left").withColumn("cov", drawn(F.col("cov"), F.col("above")))
    levels = plain.where(F.col("g") == ALL).unionByName(langs).unionByName(owns.select("g", "n", "mean", "cov"))
    return inverted(levels.select("g", F.struct("mean", "cov").alias("e")), ["e"])


def judge(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None, out: str = "rules") -> tuple[DataFrame, str]:
    """The ``carry`` columns (default: all) with a struct of the counts, base_failed, distance and kept; returns its name too."""
    out = fresh(docs, out)
    n, chars = F.col("c")["n_words"], F.greatest(F.col("c")["word_chars"], F.lit(1))
    share = lambda part, whole: F.col("c")[part] / F.greatest(whole, F.lit(1))
    group = F.concat_ws("\x1f", F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit("")), F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")))
    of_lang = F.concat(F.lit("l"), F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit("")))
    held = stash(
        docs.select(F.struct(*(carry or docs.columns)).alias("row"), group.alias("own"), of_lang.alias("of_lang"), counts_udf()(text).alias("c")).select(
            "row",
            "own",
            "of_lang",
            "c",
            ((n < MIN_WORDS) | (100 * F.col("c")["n_repeat_words"] > 50 * n)).alias("base_failed"),
            F.log(chars / F.greatest(n, F.lit(1))).alias("x_length"),
            F.sqrt(share("n_upper", chars)).alias("x_upper"),
            F.sqrt(share("n_symbols", chars)).alias("x_symbols"),
            share("n_dup_lines", F.col("c")["n_lines"]).alias("x_lines"),
            share("n_repeat_words", n).alias("x_repeat"),
        )
    )
    fit = held.where("not base_failed")
    groups = stash(fit.select("own", "of_lang").distinct())
    few = 2 * groups.count() < MAX_BROADCAST_GROUPS
    small = F.broadcast if few else lambda df: df
    rows = fit.select(F.explode(F.array("own", "of_lang", F.lit(ALL))).alias("g"), *DIMS)
    estimates = shrunk(mcd(rows, small), groups, small)
    share = rows.join(small(estimates), "g").groupBy("g").agg(F.percentile_approx(distance("e"), CORE, 10_000).alias("reach"))
    # a core of near-constant rows must not shrink the scale of the others
    scaled = stash(estimates.join(small(share), "g").select("g", F.struct("e.mean", "e.inverse", (CHI2_CORE / F.greatest("reach", F.lit(CHI2_CORE))).alias("scale")).alias("e")))
    each = groups.join(small(scaled.withColumnsRenamed({"g": "own", "e": "e_own"})), "own", "left").join(small(scaled.withColumnsRenamed({"g": "of_lang", "e": "e_lang"})), "of_lang", "left")
    top = scaled.where(F.col("g") == ALL).select("e").scalar()
    each = stash(each.select("own", F.coalesce("e_own", "e_lang", top).alias("e")))
    judged = held.join(small(each), "own", "left")
    far = distance("e") * F.col("e.scale")
    kept = ~F.col("base_failed") & ~F.coalesce(far > CUTOFF, F.lit(False))
    return judged.select("row.*", F.struct(*[F.col("c")[x].alias(x) for x in COUNTS], "base_failed", far.alias("distance"), kept.alias("kept")).alias(out)), out


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged, out = judge(docs, carry=["doc_id"])
    return judged.select("doc_id", *[F.col(out)[x].alias(x) for x in [*COUNTS, "base_failed", "kept", "distance"]])
