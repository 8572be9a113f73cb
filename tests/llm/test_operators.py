"""Each operator on awkward documents, against brute force, and on empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import decontamination, language_id, line_dedup, near_dedup, packing, pii, quality_classifier, quality_rules, substring_dedup, url_filters
from tests.llm import fixtures as fx


@pytest.fixture(scope="module")
def docs(spark):
    return fx.documents(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return fx.documents(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (9, 0), (8, 1), (99, 0), (None, 1), (7, None)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def benchmark(spark):
    items = [(1, " ".join(f"w{i}" for i in range(5, 25))), (2, "one two"), (3, None), (4, "--"), (2, "one two"), (None, "x")]
    return spark.createDataFrame(items, "item_id long, text string")


def test_url_filters(spark):
    urls = [(1, "http://A.Example.NET/en/x?q"), (2, "https://example.com/de/1#t"), (3, "http://sub.example.org/fr/"), (4, None), (5, "no scheme"), (1, "http://A.Example.NET/en/x?q"), (6, "http://net/"), (7, "http://xexample.com/de/"), (8, "://"), (None, "http://spam.test/a")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    rules = spark.createDataFrame([*url_filters.RULES, ("spam.test/", "block"), ("spam.test/", "allow")], "key string, verdict string")
    found = sorted((r["page_id"] or 0, r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(pages, rules).collect())
    assert found == sorted(
        [
            (1, "a.example.net", "/en/x", "example.net/en/", "allow"),
            (1, "a.example.net", "/en/x", "example.net/en/", "allow"),
            (2, "example.com", "/de/1", "example.com/de/", "block"),
            (3, "sub.example.org", "/fr/", "org/fr/", "allow"),
            (4, "", "", None, "allow"),
            (5, "", "", None, "allow"),
            (6, "net", "/", "net/", "block"),
            (7, "xexample.com", "/de/", None, "allow"),
            (8, "", "", None, "allow"),
            (0, "spam.test", "/a", "spam.test/", "block"),
        ],
        key=lambda r: (r[0], r[1]),
    )
    assert url_filters.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filters.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("host"), "id", F.lit(".test/")).alias("key"), F.lit("block").alias("verdict"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://host"), "id", F.lit(".test/a")).alias("url"))
    found = {r["page_id"]: r["verdict"] for r in url_filters.judge(pages, keys).collect()}
    assert all((v == "block") == (k < 3000) for k, v in found.items())


def test_substring_dedup(docs, empty):
    found, out = substring_dedup.dedup_passages(docs)
    expected = fx.passages(fx.DOCS)
    assert found.columns[:-1] == docs.columns and out not in docs.columns
    for r in found.collect():
        assert r[out]["kept"] == " ".join(expected[r["doc_id"]]), r["doc_id"]
        assert r[out]["n_words"] == len(fx.words(r["text"])) and r[out]["n_removed"] == r[out]["n_words"] - len(expected[r["doc_id"]])
    assert substring_dedup.dedup_passages(empty)[0].count() == 0


def test_substring_dedup_of_long_runs(spark):
    rows = [(i, "a " * 70 + f"b{i} " + "a b " * 30 + fx.PASSAGE) for i in range(6)]
    found, out = substring_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    expected = fx.passages(rows)
    assert {r["doc_id"]: r[out]["kept"] for r in found.collect()} == {d: " ".join(w) for d, w in expected.items()}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def fixed(text):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if ok(k, m.group())]


def test_pii(spark, docs, empty):
    odd = ["a@b.c_d@e.f", "1.2.3.4.5 256.1.1.1 0001.002.3.4", "4111-1111-1111-1111 4111 1111 1111 11112", "+1 (212) 555-0100 +12 +1234567890123456", "ä x@y.z " * 300, "9" * 5000, "a" * 50_000 + "@", "+1 1 1 1 1 1 1 1 1x"]
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    for frame in (docs, extra):
        found, out = pii.find(frame)
        assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().toString())
        for r in found.collect():
            assert list(r[out]["base"]) == fixed(r["text"]), r["doc_id"]
            assert set(r[out]["base"]) <= set(r[out]["spans"])
    added = pii.find(spark.createDataFrame([(1, "please call (212) 555-0100 now"), (2, "on 2019-03-04 it rained")], "doc_id long, text string"))
    spans = {r["doc_id"]: list(r[added[1]]["spans"]) for r in added[0].collect()}
    assert spans == {1: ["phone:12:26"], 2: []}
    assert pii.find(empty)[0].count() == 0


def test_pii_keeps_the_better_of_overlapping_spans(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(200):
        spans = [(int(a), int(a + rng.integers(1, 12)), 2.0 if rng.random() < 0.2 else float(rng.random()), "x") for a in rng.integers(0, 60, rng.integers(0, 14))]
        rows.append((i, sorted(spans)))
    rows.append((900, [(i * 3, i * 3 + 2, 0.5, "x") for i in range(3000)]))  # more than a block of them
    frame = spark.createDataFrame(rows, f"id long, spans array<{pii.CHOICE}>")
    found = {r["id"]: [tuple(s) for s in r["kept"]] for r in frame.select("id", pii.best_of(F.col("spans")).alias("kept")).collect()}
    meets = lambda a, b: a[0] < b[1] and b[0] < a[1]
    for i, spans in rows:
        kept, fixed = found[i], [s for s in spans if s[2] == 2.0]
        assert all(s in spans and s[2] < 2 for s in kept) and len(kept) == len(set(kept))
        assert not any(meets(a, b) for k, a in enumerate(kept) for b in [*kept[k + 1 :], *fixed])
        assert all(s in kept or any(meets(s, o) and o[2] >= s[2] for o in spans if o != s) or spans.count(s) > 1 for s in spans if s[2] < 2)
        if spans and not fixed:
            assert max(spans, key=lambda s: s[2]) in kept
    assert len(found[900]) == 3000


def test_language_id(spark, docs, empty):
    model = language_id.fit(docs)
    rows = {r["doc_id"]: r["f"] for r in docs.select("doc_id", language_id.predict_udf(spark, model)("text").alias("f")).collect()}
    assert rows[4]["lang"] == rows[5]["lang"] == rows[6]["lang"] == "und" and rows[4]["score"] == 0
    assert rows[11]["lang"] == "de" and 0 <= rows[11]["score"] <= 1
    nothing = language_id.fit(empty)
    assert {r["f"]["lang"] for r in docs.select(language_id.predict_udf(spark, nothing)("text").alias("f")).collect()} == {"und"}


def test_language_id_by_plain_lookup(spark):
    texts = [("en", "the cat and the dog"), ("en", "the house"), ("de", "der hund und die katze"), ("de", "das haus und der hund"), (None, "the the the")]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(texts)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    counts = {x: Counter(w for y, t in texts if y == x for w in t.split()) for x in ("de", "en")}
    total = sum(sum(c.values()) for c in counts.values())

    def log(w, x):
        pooled = sum(c[w] for c in counts.values()) / total
        return np.log((counts[x][w] + language_id.PRIOR * pooled) / (sum(counts[x].values()) + language_id.PRIOR))

    asked = ["the hund", "und the the cat", "½", "²③ Ⅷ 12 --", "HAUS", "", None, "xyzzy"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "id long, text string").select("id", language_id.predict_udf(spark, model)("text").alias("f")).collect()
    found = {r["id"]: (r["f"]["lang"], r["f"]["score"]) for r in rows}
    for i in (0, 1, 4):
        score = {x: sum(log(w, x) for w in asked[i].lower().split()) for x in counts}
        best = max(score, key=score.get)
        assert found[i][0] == best and abs(found[i][1] - 1 / sum(np.exp(v - score[best]) for v in score.values())) < 1e-9
    assert [found[i] for i in (2, 3, 5, 6)] == [("und", 0.0)] * 4 and found[7][0] in counts


def test_language_id_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = language_id.op4_language_id(spark, sf).where("held_out").join(truth, "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()


def test_near_dedup(docs, empty):
    comps, sizes = fx.components(fx.DOCS)
    found = near_dedup.near_duplicates(docs).collect()
    assert len(found) == len(fx.DOCS)
    for r in found:
        assert (r["component_id"], r["n_shingles"], r["kept"]) == (comps[r["doc_id"]], sizes[r["doc_id"]], comps[r["doc_id"]] == r["doc_id"])
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(d or 0 for d in {d for d, *_ in fx.DOCS} if comps[d] == d)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_of_a_large_family(spark):
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for d in range(300):
        copy = list(base)
        for i in rng.choice(150, rng.integers(0, 5), replace=False):
            copy[i] = f"z{d}"
        rows.append((d, " ".join(copy)))
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == fx.components(rows)[0]


def test_near_dedup_finds_all_links_of_a_table(spark):
    """Against all pairs of the 1,000 documents of sf0.01, at the query's similarity."""
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    comps, sizes = fx.components(rows)
    found = near_dedup.op5_near_dedup(spark, sf).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == comps and {r["doc_id"]: r["n_shingles"] for r in found} == sizes
    assert len(set(comps.values())) < len(comps) - 20


def test_decontamination(docs, benchmark, empty):
    for options in ({}, {"block_bytes": 20}):  # one block of items, and many
        seen, out = decontamination.scan(docs, benchmark, **options)
        rows = {r["doc_id"]: r[out] for r in seen.collect()}
        assert (rows[1]["n_hit"], list(rows[1]["items"])) == (20, ["1"]) and rows[7]["contaminated"] and list(rows[7]["items"]) == ["2"]
        assert not rows[4]["contaminated"] and rows[4]["n_words"] == 0 and rows[8]["n_hit"] == 0
    assert decontamination.scan(docs, benchmark.limit(0))[0].where(f"{out}.contaminated").count() == 0
    assert decontamination.scan(empty, benchmark)[0].count() == 0
    assert decontamination.remove_contaminated(docs, benchmark).columns == docs.columns


def test_quality_rules(docs, empty):
    judged, out = quality_rules.judge(docs)
    for r in judged.collect():
        w = fx.words(r["text"])
        assert r[out]["n_words"] == len(w) and r[out]["word_chars"] == sum(map(len, w)) and r[out]["n_repeat_words"] == fx.repeated(w)
        assert r[out]["base_failed"] == (len(w) < 50 or 100 * fx.repeated(w) > 50 * len(w)) and not (r[out]["base_failed"] and r[out]["kept"])
    assert judged.columns[:-1] == docs.columns
    assert quality_rules.judge(empty)[0].count() == 0


def test_quality_rules_against_numpy(spark):
    """The estimates of one group, which is its language and all rows too, by plain concentration steps."""
    rng = np.random.default_rng(11)
    texts = [" ".join(("W" if rng.random() < 0.1 + i % 7 / 50 else "w") + "x" * int(rng.integers(1, 4 + i % 5)) + ("#" if rng.random() < 0.05 else "") + str(rng.integers(400)) for _ in range(80)) for i in range(150)]
    texts += [" ".join(f"#{'A' * int(rng.integers(5, 9))}{rng.integers(99)}$" for _ in range(80)) for _ in range(12)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    judged, out = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    found = {r["doc_id"]: r[out] for r in judged.collect()}
    x = []
    for t in texts:
        w = t.split()
        chars = sum(map(len, w))
        x.append([np.log(chars / len(w)), np.sqrt(sum(c.isupper() for c in t) / chars), np.sqrt(sum(c in "#*$%&|<>" for c in t) / chars), 0.0, fx.repeated(w) / len(w)])
    x = np.array(x)
    x = x[[not found[i]["base_failed"] for i in range(len(x))]]
    core = -(-3 * len(x) // 4)
    floor, best = np.diag(quality_rules.FLOORS) ** 2, None
    mid = np.sort(x, axis=0)[-(-len(x) // 2) - 1]
    away = 1.4826 * np.sort(np.abs(x - mid), axis=0)[-(-len(x) // 2) - 1]
    for mean, cov in ((mid, np.diag(away**2)), (x.mean(axis=0), np.cov(x.T, bias=True))):
        for _ in range(30):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov + floor), x - mean)
            inner = x[d <= np.sort(d)[core - 1]]
            mean, cov = inner.mean(axis=0), np.cov(inner.T, bias=True)
        det = np.linalg.slogdet(cov + floor)[1]
        if best is None or det < best[0] - 1e-9:
            best = det, mean, cov
    _, mean, cov = best
    d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov + floor), x - mean)
    d *= quality_rules.CHI2_CORE / max(quality_rules.CHI2_CORE, np.sort(d)[core - 1])
    own = [found[i]["distance"] for i in range(len(texts)) if not found[i]["base_failed"]]
    assert np.allclose(own, d, rtol=0.02, atol=0.05)
    kept = [found[i]["kept"] for i in range(len(texts)) if not found[i]["base_failed"]]
    assert kept == (d <= quality_rules.CUTOFF).tolist() and 0 < kept.count(False) < 30


def test_quality_rules_reject_outliers(spark):
    clean = [(i, " ".join(f"word{(i * 7 + j * 13) % 900}" for j in range(120)), "en", "s") for i in range(400)]
    junk = [(1000 + i, " ".join(f"#*w{j}$$" for j in range(120)), "en", "s") for i in range(5)]
    judged, out = quality_rules.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string"))
    assert {r["doc_id"] for r in judged.where(f"not {out}.kept").collect()} == {d for d, *_ in junk}


def test_line_dedup(docs, empty):
    seen, expected = [], {}
    for d, t, *_ in sorted({(r[0], r[1]) for r in fx.DOCS}, key=lambda r: (r[0] is not None, r[0] or 0)):
        kept = []
        for line in (t or "").split("\n"):
            own = set(fx.words(line))
            if not own or not any(len(own & s) >= 0.9 * len(own | s) - 1e-9 for s in seen):
                kept.append(line)
            if own:
                seen.append(own)
        expected[d] = None if t is None else "\n".join(kept)
    found = line_dedup.dedup_lines(docs)
    assert found.columns == docs.columns and found.count() == len(fx.DOCS)
    assert {r["doc_id"]: r["text"] for r in found.collect()} == expected
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("threshold", [0.6, 0.75, 0.8, 1.0])
def test_line_dedup_at_thresholds(spark, threshold):
    rng = np.random.default_rng(5)
    bases = [rng.choice(60, rng.integers(3, 30)).tolist() for _ in range(20)]
    rows, seen, expected = [], [], {}
    for d in range(60):
        lines = []
        for _ in range(rng.integers(1, 8)):
            line = list(bases[rng.integers(20)])
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                line[rng.integers(len(line))] = rng.integers(2000)
            lines.append(" ".join(f"w{x}" for x in line))
        rows.append((d, "\n".join(lines)))
        kept = []
        for line in lines:
            own = set(line.split())
            if not any(len(own & s) >= threshold * len(own | s) - 1e-9 for s in seen):
                kept.append(line)
            seen.append(own)
        expected[d] = "\n".join(kept)
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), threshold=threshold)
    assert {r["doc_id"]: r["text"] for r in found.collect()} == expected


def test_line_dedup_is_native(docs):
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_quality_classifier(docs, labels, empty):
    model = quality_classifier.fit(docs, labels)
    scored, out = quality_classifier.score(docs, model)
    rows = {r["doc_id"]: r[out] for r in scored.collect()}
    assert all(0 <= v <= 1 for v in rows.values()) and rows[9] < rows[8]
    blank = quality_classifier.fit(docs, labels.limit(0))
    assert {r[out] for r in quality_classifier.score(docs, blank)[0].collect()} == {0.5}
    assert quality_classifier.score(empty, model)[0].count() == 0


def test_quality_classifier_votes_like_a_plain_sort(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"{'good' if i % 2 else 'bad'}{rng.integers(30)}" for _ in range(20)) for i in range(40)]
    texts += texts[:6] * 2  # ties
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(46)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    features = quality_classifier.Features()
    model.cut = model.at = 0.5  # plain shares
    scored, out = quality_classifier.score(docs, model, neighbours=7)
    for r in scored.collect():
        ids, weights = features.of(r["text"].encode())
        own = quality_classifier.unit(np.array([model.projection[ids].T @ weights.astype(np.float32)]))
        cosine = np.round((own @ model.vectors.T)[0], 5)
        near = sorted(range(len(cosine)), key=lambda i: (-cosine[i], i))[:7]
        weight = [max(float(cosine[i]), 0) + 1e-9 for i in near]
        assert abs(r[out] - sum(w * model.labels[i] for w, i in zip(weight, near)) / sum(weight)) < 1e-3


def test_quality_classifier_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    found = quality_classifier.op9_quality_classifier(spark, sf).where("held_out").join(labels, "doc_id")
    rows = found.select("quality", "predicted").collect()
    for label in (0, 1):  # each label by itself: one is rare
        right = [r["predicted"] == label for r in rows if r["quality"] == label]
        assert sum(right) >= 0.97 * len(right)


def test_quality_classifier_parts_labels_at_the_threshold(spark):
    """Shares of votes of an uneven sample lie on one side of 0.3; calibrated scores do not, and keep their order."""
    rng = np.random.default_rng(4)
    word = lambda i: f"{'bad' if i % 10 == 0 else 'good'}{rng.integers(20)}" if rng.random() < 0.6 else f"w{rng.integers(40)}"
    texts = [" ".join(word(i) for _ in range(30)) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(300)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    score = lambda: {r[0]: r[1] for r in quality_classifier.score(docs, model)[0].select("doc_id", "score").collect() if r[0] >= 300}
    scores, cut, at = score(), model.cut, model.at
    assert at == 0.3 and all((s >= 0.3) == (i % 10 > 0) for i, s in scores.items())
    model.cut = model.at = 0.5
    shares = score()
    assert all((shares[i] < cut) == (scores[i] < 0.3) for i in scores)
    assert sorted(scores, key=lambda i: (scores[i], i)) == sorted(scores, key=lambda i: (shares[i], i))


def test_packing(docs, empty):
    found = packing.pack(docs, capacity=64, small=16, groups=8).collect()
    tokenizer = packing.Encoder(packing.default_tokenizer()).tokenizer
    ids = {d: tokenizer.encode(t, add_special_tokens=False).ids + [0] if t else [0] for d, t, *_ in fx.DOCS}
    for r in found:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
        assert r["length"] == 64 or r["piece"] == 0
    assert sum(r["length"] for r in found) == sum(len(ids[d]) for d, *_ in fx.DOCS)
    by = {}
    for r in sorted(found, key=lambda r: r["offset"]):
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 64 and len(by) <= -(-sum(by.values()) // 64) + 3
    assert packing.pack(empty).count() == 0


def test_packing_plan_places_everything_once():
    rng = np.random.default_rng(5)
    hist = {int(n): int(c) for n, c in zip(rng.choice(np.arange(1, 2048), 700, replace=False), rng.integers(1, 200, 700))}
    runs = packing.plan(hist)
    placed, load = {}, {}
    for length, rank, count, first, offset in runs:
        placed.setdefault(length, []).extend(range(rank, rank + count))
        for s in range(first, first + count):
            load.setdefault(s, []).append((offset, length))
    assert {n: sorted(r) for n, r in placed.items()} == {n: list(range(c)) for n, c in hist.items()}
    for pieces in load.values():
        ends = 0
        for offset, length in sorted(pieces):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert len(load) <= 1.02 * sum(n * c for n, c in hist.items()) / 2048 + 1


def test_pipeline(spark, tmp_path):
    sf = str(tmp_path)
    fx.documents(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 1), (9, 0), (8, 1)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(sorted(r["doc_id"] or 0 for r in docs.collect()))
    assert 9 not in kept[0] and kept[1] == kept[0] and 7 not in kept[3] and kept[2].count(3) <= 1
    assert {r["doc_id"] or 0 for r in corpus_pipeline.run(spark, sf).collect()} == set(kept[3])


def test_hash_of_removed_text_is_of_utf8(docs):
    assert docs.where("doc_id = 11").select(F.sha2(F.col("text").cast("binary"), 256)).first()[0] == hashlib.sha256(fx.DOCS[-1][1].encode()).hexdigest()
