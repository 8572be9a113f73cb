"""The digest index, periodic runs and the Merkle manifest against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import digest_index, merkle, periodic_runs
from foliant.llm.common import shared_dir
from tests.llm import fixtures as fx


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return fx.documents(spark).cache()


# --- Digest index ----------------------------------------------------------------------------------

def everything():
    return [("all", F.lit(True))]


def copies(rows):
    """Rows of (id, text) -> sorted (id, keep_id, group_size, kept, digest)."""
    groups = {}
    for d, t in rows:
        groups.setdefault(sha(re.sub(r"[\x20\x09-\x0D]+", " ", t or "")), []).append(d)
    out = []
    for digest, ids in groups.items():
        ids.sort(key=lambda d: (d is not None, d or 0))
        out += [(d, ids[0], len(ids), i == 0, digest) for i, d in enumerate(ids)]
    return sorted(out, key=repr)


def judged(found, out):
    c = F.col(out)
    return sorted((tuple(r) for r in found.select("doc_id", c["keep_id"], c["group_size"], c["kept"], F.lower(F.hex(c["digest"]))).collect()), key=repr)


def test_exact_dedup(spark, docs):
    found, out = digest_index.dedup_exact(docs, digest_index.DigestIndex(spark, shared_dir(spark)), everything())
    assert found.columns[:-1] == docs.columns and out not in docs.columns
    assert judged(found, out) == copies([r[:2] for r in fx.DOCS])
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().toString())
    found, out = digest_index.dedup_exact(docs.limit(0), digest_index.DigestIndex(spark, shared_dir(spark)), everything())
    assert found.count() == 0


def test_exact_dedup_of_a_large_group(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice(["a  b", "a\tb", "a b", f"t {rng.randrange(40)}", " a b", "a b", None, ""])) for i in rng.sample(range(3000), 1500)]
    found, out = digest_index.dedup_exact(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), digest_index.DigestIndex(spark, shared_dir(spark), buckets=5), [("low", F.col("id") < 1000), ("high", F.col("id") >= 1000)])
    assert judged(found, out) == copies(rows)


def test_index_outlives_its_session_and_takes_a_batch_again(spark):
    path = shared_dir(spark)
    first = spark.createDataFrame([(5, "x"), (7, "y"), (9, "y")], "doc_id long, text string")
    then = spark.createDataFrame([(1, "y"), (2, "z"), (3, "z")], "doc_id long, text string")
    digest_index.dedup_exact(first, digest_index.DigestIndex(spark, path, buckets=3), [("one", F.lit(True))])
    spark.sql(f"DROP TABLE {digest_index.DigestIndex(spark, path).name}")  # a new session's catalog does not know it
    for _ in range(2):  # a repeated batch replaces itself
        index = digest_index.DigestIndex(spark, path, buckets=99)
        assert index.buckets == 3
        found, out = digest_index.dedup_exact(then, index, [("two", F.lit(True))])
        assert {(r["doc_id"], r[out]["keep_id"], r[out]["kept"]) for r in found.collect()} == {(1, 7, False), (2, 2, True), (3, 2, False)}
        assert index.entries().count() == 3


def test_anti_join_does_not_shuffle_the_index(spark):
    index = digest_index.DigestIndex(spark, shared_dir(spark))
    rows = spark.range(100).select(F.col("id"), F.col("id").alias("row"), digest_index.digest(F.col("id").cast("string")).alias("digest"))
    index.append(rows, "a")
    plan = index.judge(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


# --- Periodic runs ---------------------------------------------------------------------------------


def brute_runs(words):
    """(start, length, period) of all runs, by trying every period."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        start = 0
        for i in range(len(words) - p + 1):
            if i == len(words) - p or words[i] != words[i + p]:
                if i - start + p >= max(12, 2 * p):
                    found.setdefault((start, i + p), p)  # the smallest period comes first
                start = i + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def texts_with_runs():
    rng = random.Random(12)
    thue = [bin(i).count("1") % 2 for i in range(512)]
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    yield from ([], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 500, list("ab") * 100, list("abc") * 4, list("abcab") * 2 + ["a"], list(fibonacci[-1]), thue, thue[:200] * 3)
    for _ in range(120):
        words = []
        while len(words) < rng.randrange(1, 300):
            unit = [rng.choice("abcd") for _ in range(rng.randrange(1, 25))]
            words += unit * rng.randrange(1, 6) + unit[: rng.randrange(len(unit))]
        yield words


def test_runs():
    for words in texts_with_runs():
        numbers = periodic_runs.numbered([str(w).encode() for w in words])
        assert [tuple(r) for r in periodic_runs.find_runs(numbers).tolist()] == brute_runs(words), words


def test_runs_in_small_blocks_and_with_colliding_hashes(monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK", 16)
    for words in list(texts_with_runs())[:40]:
        assert [tuple(r) for r in periodic_runs.find_runs(periodic_runs.numbered([str(w).encode() for w in words])).tolist()] == brute_runs(words)
    # sums modulo a tiny prime: many unequal stretches look equal, comparing the words has to mend it
    monkeypatch.setattr(periodic_runs, "PRIMES", (3,))
    monkeypatch.setattr(periodic_runs, "BASES", (2,))
    for words in list(texts_with_runs())[:40]:
        assert [tuple(r) for r in periodic_runs.find_runs(periodic_runs.numbered([str(w).encode() for w in words])).tolist()] == brute_runs(words)


def expected_runs(doc_id, text):
    words = fx.words(text)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, l, p in runs for i in range(s + p, s + l)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    exponent = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, exponent, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs_query(spark, docs, tmp_path):
    rows = [r[:2] for r in fx.DOCS if r[0] != 8] + [(i, f"w{i} " + fx.PASSAGE + " x" * (i % 30) + " y z" * (i % 11)) for i in range(100, 160)] + [(200, " ".join(f"v{i % 97}" for i in range(700)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted((tuple(r) for r in periodic_runs.op12_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert found == sorted((expected_runs(*r) for r in rows), key=repr)
    assert any(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows)


def test_collapse_runs_keeps_other_columns(spark, docs):
    found, out = periodic_runs.collapse_runs(docs)
    assert found.columns[:-1] == docs.columns and out not in docs.columns
    kept = {r["doc_id"]: r[out] for r in found.collect()}
    assert kept[9]["kept"] == "x" and [tuple(x) for x in kept[9]["runs"]] == [(0, 60, 1)]
    assert kept[4]["kept"] == "" and kept[4]["runs"] == []
    assert periodic_runs.collapse_runs(docs.limit(0))[0].count() == 0


def test_runs_of_a_long_text():
    words = np.random.default_rng(3).integers(0, 5000, 200_000)
    words[50_000:120_000] = np.resize(words[50_000:50_700], 70_000)
    found = [tuple(r) for r in periodic_runs.find_runs(words.astype(np.int64)).tolist()]
    assert max(found, key=lambda r: r[1])[2] == 700 and all(np.array_equal(words[s : s + l - p], words[s + p : s + l]) for s, l, p in found)


# --- Merkle manifest -------------------------------------------------------------------------------


def shrink(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def climb(levels, pos):
    """(sibling or None, whether it is on the left) of every level."""
    out = []
    for level in levels[:-1]:
        other = pos ^ 1
        out.append((level[other] if other < len(level) else None, pos % 2 == 1))
        pos //= 2
    return out


def brute_manifest(rows):
    """Rows of (doc_id, source, lang, n_chars, text) -> what the query returns."""

    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {lang: shrink([leaf(r) for r in groups[lang]]) for lang in langs}
    top = shrink([trees[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for pos, r in enumerate(groups[lang]):
            path = climb(trees[lang], pos) + climb(top, k)
            altered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            acc = leaf((*r[:3], r[3] + 1, r[4])) if altered else leaf(r)
            for sibling, left in path:
                acc = sha((sibling or "") + acc if left else acc + (sibling or ""))
            out.append((r[0], leaf(r), trees[lang][-1][0], top[-1][0], sha("".join(s or "" for s, _ in path)), acc, acc == top[-1][0]))
    return sorted(out, key=repr)


def test_merkle_manifest(spark, tmp_path):
    rng = random.Random(13)
    rows = [(d, s, lang, len(t) if t else None, t) for d, t, lang, s in fx.DOCS]
    rows += [(i, rng.choice(["s", None]), rng.choice(["en", "en", "en", "ä", "z", "fr"]), rng.choice([3, None]), f"t{i}") for i in range(100, 180)] + [(999, None, "only", 1, "x"), (None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    found = merkle.op13_merkle_manifest(spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    expected = brute_manifest(rows)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected
    # blocks of other sizes, which take more walks, give the same tree
    leaves = found.select("doc_id", "leaf").join(spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", "lang").distinct(), "doc_id")
    for height in (1, 2):
        tops = {(r["doc_id"], r["leaf"], r["subroot"], r["root"]) for r in merkle.manifest(leaves.where("doc_id <> 3"), group="lang", order=["doc_id"], height=height).collect()}
        small = {(r["doc_id"], r["leaf"], r["subroot"], r["root"]) for r in merkle.manifest(leaves.where("doc_id <> 3"), group="lang", order=["doc_id"]).collect()}
        assert tops == small


def test_merkle_manifest_of_few_rows(spark, docs, tmp_path):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    for k, rows in enumerate([[], [(1, "s", "en", 1, "x")], [(1, "s", "en", 1, "x"), (2, "s", "de", 1, "y")]]):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{k}/documents.parquet"))
        found = merkle.op13_merkle_manifest(spark, str(tmp_path / str(k)))
        assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_manifest(rows)
    leaves = docs.withColumns({"leaf": F.sha2("text", 256), "grp": F.lit(1), "pos": F.lit(2)})
    found = merkle.manifest(leaves, group="lang", order=["doc_id"])
    assert found.columns == [*leaves.columns, "subroot", "root", "path"] and found.count() == docs.count()
    assert found.where(merkle.fold(F.coalesce("leaf", F.lit("-")), F.col("path")) != F.col("root")).count() == 0
