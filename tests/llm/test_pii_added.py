"""Spans that the boosted trees add: recall and precision on texts of their own, and a plain walk of the trees."""

import math
import random

import regex

from foliant.llm import pii
from pyspark.sql import functions as F


def passing(stem: str, step: int = 0) -> str:
    """The stem with the digit that passes the Luhn check, or one that is ``step`` further."""
    digits = [int(c) for c in stem if c.isdigit()]
    total = sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(reversed(digits)))
    return stem + str((-total + step) % 10)


def made(rng: random.Random, form: str) -> str:
    return "".join(str(rng.randrange(10)) if c == "9" else c for c in form)


def test_recall_and_precision(spark):
    rng = random.Random(11)
    names, hosts = ["kim.lee", "sales", "t_ohara", "q.z7"], ["nimbus", "lab", "kite-shop"]
    rows = []  # kind, text before, span, wanted
    for _ in range(60):
        at, dot = rng.choice([("(at)", "(dot)"), (" [at] ", " [dot] "), (" at ", " dot "), (" (at) ", "."), ("[at]", "[dot]")])
        domain = dot.join([*rng.sample(hosts, rng.choice([1, 2])), rng.choice(["org", "com", "fr"])])
        rows.append(("email", rng.choice(["please contact ", "the desk is ", "my mail: "]), rng.choice(names) + at + domain, True))
        rows.append(("email", rng.choice(["nobody ", "we all ", "the mail "]), rng.choice(["stayed at home. Then", "smiled at her. But", "was at sea. It"]), False))
        rows.append(("phone", rng.choice(["ring ", "please call ", "my new phone ", "fax no "]), made(rng, rng.choice(["(999) 999-9999", "0399 999 9999", "0999/999999", "999.999.9999"])), True))
        rows.append(("phone", rng.choice(["the date was ", "a total of ", "in order ", "it grew to "]), made(rng, rng.choice(["2019-09-19", "29.09.2019", "99 999 999", "99.99.99"])), False))
        rows.append(("ip", rng.choice(["from host ", "the address ", "blocked "]), made(rng, rng.choice(["19[.]99[.]9[.]199", "2001:db8:9:99:9:9:99:9", "99(.)9(.)99(.)99", "fe80::99:a9b"])), True))
        rows.append(("ip", rng.choice(["section ", "they got ", "until "]), made(rng, rng.choice(["9. 9. 9. 9", "09:29:19:09:19", "99. 9. 99. 9"])), False))
        form = rng.choice(["4999.9999.9999.999", "5999/9999/9999/999", "4999_9999_9999_999"])
        rows.append(("card", rng.choice(["my visa ", "paid with card ", "credit card: "]), passing(made(rng, form)), True))
        rows.append(("card", rng.choice(["they read ", "the invoice ", "token "]), passing(made(rng, form), rng.randrange(1, 10)), False))
    texts = spark.createDataFrame([(i, before + span + ", he said") for i, (_, before, span, _) in enumerate(rows)], "doc_id long, text string")
    found, out = pii.find(texts)
    spans = {r["doc_id"]: set(r[out]["spans"]) for r in found.collect()}
    for kind in pii.KINDS:
        right = missed = wrong = 0
        for i, (k, before, span, wanted) in enumerate(rows):
            own = {s for s in spans[i] if s.startswith(kind)}
            hit = f"{kind}:{len(before)}:{len(before) + len(span)}" in own
            right += k == kind and wanted and hit
            missed += k == kind and wanted and not hit
            wrong += len(own) - (k == kind and wanted and hit)
        assert right / (right + missed) >= 0.9, (kind, right, missed)
        assert right / (right + wrong) >= 0.9, (kind, right, wrong)


def plain_features(kind: str, match: str, before: str) -> dict[str, float]:
    digits = "".join(c for c in match if c in "0123456789")
    groups, parts = regex.findall("[0-9]+", match), regex.findall("[0-9A-Za-z]+", match)
    seen = lambda pattern, text: bool(regex.search(pattern, text, regex.ASCII))  # noqa: E731 - as Java does
    luhn = 13 <= len(digits) <= 19 and passing(digits[:-1]) == digits
    date = seen(r"^(?:(?:19|20)[0-9]{2}[-/.][01]?[0-9][-/.][0-3]?[0-9]|[0-3]?[0-9][-/.][01]?[0-9][-/.](?:19|20)[0-9]{2})\b", match)
    at_form = 2 if seen(r"(?i)[(\[]at[)\]]", match) else 1 if "@" in match else 0
    dot_form = 3 if seen(r"(?i)[(\[](?:dot|\.)[)\]]", match) else 2 if seen("(?i) dot ", match) else 0 if ". " in match else 1
    values = [
        pii.KINDS.index(kind), len(match), len(digits), len(groups), max(map(len, groups), default=0), "(" in match, len(regex.sub("[0-9A-Za-z ]", "", match)), luhn,
        seen(pii.HINTS[kind], before), seen(pii.AGAINST, before), date, len(digits) / len(match), at_form, dot_form, seen(pii.ENDING, match), len(parts),
        max(map(len, parts), default=0), 0 if seen(r"^\(?0", match) else int(digits[0]) if digits else -1, match.count(" "), "[" in match, seen(r"::|  |--|\.\.", match),
    ]
    return dict(zip(pii.FEATURES, map(float, values)))


def walk(tree, f: dict[str, float]) -> float:
    while not isinstance(tree, float):
        name, threshold, low, high = tree
        tree = low if f[name] <= threshold else high
    return tree


def test_candidates_and_scores_by_a_plain_walk(spark):
    rng = random.Random(5)
    bits = ["a.b (at) c dot", " dot org", "0171 555 0199", "(212) 555-0100", " call ", " order ", "10[.]0[.]1[.]2", "fe80::1", "12:30:45:10:11", "4111.1111.1111.1111", " card ", "2019-03-04", " ", ", ", "x", " at ", ". Then", "@", "7", "ü", "😀", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(150)] + ["", "9" * 300, "a " * 2000]
    scorer = pii.Scorer.get(spark)
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for kind in pii.KINDS:
        scored = F.transform(pii.candidates(F.col("text"), kind), lambda c: F.struct(c["start"], c["end"], scorer.score(c["f"], kind)))
        for r in frame.select("id", scored.alias("c")).collect():
            wanted, last, text = [], 0, texts[r["id"]]
            for m in regex.finditer(pii.LOOSE[kind], text):
                f = plain_features(kind, m.group(), text[max(last, m.start() - pii.BEFORE) : m.start()])
                wanted.append((m.start(), m.end(), 1 / (1 + math.exp(-2 * sum(w * walk(t, f) for w, t in scorer.trees)))))
                last = m.start()
            found = [tuple(c) for c in r["c"]]
            assert [c[:2] for c in found] == [c[:2] for c in wanted], (kind, text)
            assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(found, wanted)), (kind, text, found, wanted)
