"""op8 does no more work than it must."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import line_dedup


def representatives_of(spark, lines):
    docs = spark.createDataFrame(list(enumerate(lines)), "d long, spaced string").withColumn("h", F.lit(0).cast("long"))
    return line_dedup.representatives(docs, line_dedup.rarity(docs), 0.8)


@pytest.mark.parametrize("n", [39, 71, 72, 130, 199, 200, 260])
def test_parity_bits_bound_the_difference(spark, n):
    rng = np.random.default_rng(n)
    base = [f"w{i}" for i in range(n)]
    lines = [base]
    for k in range(1, 30):
        size = int(rng.integers(0, n // 3))
        lines.append([*rng.permutation(base)[: n - size].tolist(), *[f"new{k}x{i}" for i in range(int(rng.integers(0, n // 3)))]])
    reps = representatives_of(spark, [" ".join(line) for line in lines])
    x, y = line_dedup.sided(reps, "x"), line_dedup.sided(reps, "y")
    for r in x.crossJoin(y).select("dx", "dy", line_dedup.differ(F.col("nx"), F.col("ny")).alias("least")).collect():
        assert r["least"] <= len(set(lines[r["dx"]]) ^ set(lines[r["dy"]]))
    if n == 71:  # one walk over the words is enough
        assert reps.where("n < 72 and b1 <> 0").count() == 0


def test_joins_read_one_exchange_and_lines_meet_by_size(spark):
    """Both sides of the star and of the prefix join come from one exchange; lines of far sizes do not meet."""
    rng = np.random.default_rng(3)
    lines = [" ".join(f"w{x}" for x in rng.integers(0, 400, int(rng.integers(5, 90)))) for _ in range(300)]
    reps = line_dedup.stash(representatives_of(spark, lines)).where("prefix is not null").withColumn("open", F.lit(1))
    with line_dedup.dealt_by_words(spark):
        for found in (line_dedup.star_pairs(reps.drop("open"), 0.8), line_dedup.prefix_pairs(reps, 0.8)):
            found.collect()
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "ReusedExchange" in plan or "Exchange" not in plan.split("Initial Plan")[0]
    assert "band" in plan
    assert spark.conf.get(line_dedup.ALL_KEYS) == "true"


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9])
def test_sizes_at_the_edges_of_bands(spark, threshold):
    """Every line next to the smallest line that holds it and is just similar, in both orders."""
    lines, similar = [], set()
    for a in range(1, 120):
        b = int(a / threshold + 1e-9)
        if b > a:
            small, large = [f"s{a}w{i}" for i in range(a)], [f"s{a}w{i}" for i in range(b)]
            lines += [" ".join(small), " ".join(large)] if a % 2 else [" ".join(large), " ".join(small)]
            similar.add(len(lines) - 1)
    reps = representatives_of(spark, lines) if threshold == 0.8 else None
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "doc_id long, text string")
    gone = {r["doc_id"] for r in line_dedup.dedup_lines(docs, threshold=threshold).where("text = ''").collect()}
    assert gone == similar
    if reps is not None:  # the prefix join finds them without the star join
        marked = line_dedup.stash(reps).where("prefix is not null").withColumn("open", F.lit(1))
        assert {r["dx"] for r in line_dedup.prefix_pairs(marked, threshold).collect()} >= similar
