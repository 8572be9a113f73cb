"""Personal data: fixed patterns, and candidates judged by gradient-boosted trees.

The fixed patterns (email, ip, card, phone) always count. Beside them high-recall generators propose
looser, overlapping spans: obfuscated addresses, other number formats. Each candidate gets features of
its format and of the text around it, boosted trees score it, and a threshold for each kind,
calibrated on held-out labelled examples, selects the spans to add.

All of it is DataFrame functions. The trees are trained by Spark's own boosting on ``EXAMPLES`` labelled
examples, each put together from a context, a form and random digits or names; thresholds are
calibrated on contexts that training never sees, and on further forms. The trees are then written as CASE expressions over
the features, so that scoring happens inside the row: no shuffle, no Python, and a text's spans never
leave its row. Matches are located by splitting a text at the same pattern that extracts them. Patterns
are linear in the text (possessive or bounded repetition), also for very long runs.

Defined cases: a null text counts as empty and has no spans; repeated rows are judged one by one; a
candidate that overlaps a fixed span is dropped, of two overlapping candidates the better stays (ties:
the first), so of a chain of them not all need go; other columns are kept as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import fresh, table

KINDS = ["email", "ip", "card", "phone"]
#: The fixed patterns. Possessive repetition and the anchors change no match; they keep the search linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to match; None: the pattern itself is asked first.
GUARD = {"email": "@", "ip": None, "card": None, "phone": "+"}
#: Generators of candidates.
_AT = r"(?:\((?i:at)\)|\[(?i:at)\]|(?<= )(?i:at)(?= )|@)"
_DOT = r"(?:\((?i:dot)\)|\[(?i:dot)\]|(?<= )(?i:dot)(?= )|\.)"
LOOSE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{{0,63}}+ ?{_AT} ?[A-Za-z0-9-]{{1,63}}+(?: ?{_DOT} ?[A-Za-z0-9-]{{1,63}}+){{0,4}} ?{_DOT} ?[A-Za-z]{{2,24}}(?![A-Za-z])",
    "ip": r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)|\[dot\]) ?[0-9]{1,3}){3})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ._/-]{0,2}[0-9]{3,6}){2,3}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.+/-])\(?[0-9]{2,5}\)?(?:[ ./-]{0,2}[0-9]{2,5}){2,4}(?![0-9A-Za-z])",
}
HINTS = {
    "email": r"(?i)\b(?:e-?mails?|mail|contact|write|reach|address|kontakt|correo|courriel|schreiben)\b",
    "ip": r"(?i)\b(?:ip|ipv[46]|host|address|server|client|adresse|gateway|login from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|pay|karte|tarjeta|carte)\b",
    "phone": r"(?i)\b(?:phone|tel|call|ring|dial|text|sms|whatsapp|mobile|fax|cell|telefon|handy|tel.fono|t.l.phone|reach)\b",
}
AGAINST = r"(?i)\b(?:date|version|order|invoice|id|no|nr|page|isbn|issn|total|price|token|section|build|serial|sum|item|row|ticket|part)\b\W*$"
#: Endings that most domains have.
ENDING = r"(?i)(?:com|org|net|edu|gov|info|io|eu|[dc]e|ch|at|fr|es|it|nl|uk|us|jp|pl|se|ru|br)$"
FEATURES = [
    "kind", "length", "digits", "groups", "longest", "parens", "marks", "luhn", "hint", "against", "date", "digit_share",
    "at_form", "dot_form", "ending", "parts", "widest", "leading", "breaks", "brackets", "double",
]
#: A match with the text before it that its features look at.
SPAN = "struct<start:int,end:int,match:string,before:string>"
#: Characters of that text, which begins at the previous match of the same pattern at the earliest.
BEFORE = 30
PLACES = f"struct<at:int,some:array<{SPAN}>,full:array<array<{SPAN}>>>"
CHOICE = "struct<start:int,end:int,p:double,kind:string>"
#: Stands for the probability of fixed spans, above all others.
FIXED = 2.0
TREES, DEPTH, EXAMPLES, PRECISION = 12, 4, 6_000, 0.99


def located(text: Column, pattern: str) -> Column:
    """All matches as (start, end, match), in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    ends = F.concat(F.array(F.lit("")), F.transform(found, lambda m: F.right(m, F.lit(BEFORE))))
    pairs = F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("match"), F.slice(ends, F.lit(1), F.size(found)).alias("end")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), x["match"].alias("match"), F.right(F.concat(x["end"], F.right(x["gap"], F.lit(BEFORE))), F.lit(BEFORE)).alias("before")))
    nothing, nested = F.array().cast(f"array<{SPAN}>"), F.array().cast(f"array<array<{SPAN}>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["match"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), x["before"].alias("before")))
        room = F.size(acc["some"]) < 256  # spans gather in blocks, so that appending stays cheap
        some = F.when(room, F.concat(acc["some"], one)).otherwise(one)
        full = F.when(room, acc["full"]).otherwise(F.concat(acc["full"], F.array(acc["some"])))
        return F.struct(end.alias("at"), some.alias("some"), full.alias("full")).cast(PLACES)

    start = F.struct(F.lit(0).alias("at"), nothing.alias("some"), nested.alias("full")).cast(PLACES)
    return F.aggregate(pairs, start, step, lambda acc: F.flatten(F.concat(acc["full"], F.array(acc["some"]))))


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).try_cast("int") * (1 + i % 2)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = digits_of(match)
    if kind == "ip":
        value = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(value(p)) <= 3) & F.coalesce(value(p).try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def fixed_spans(text: Column, kind: str) -> Column:
    spans = F.filter(located(text, BASE[kind]), lambda s: valid(kind, s["match"]))
    guard = F.instr(text, GUARD[kind]) > 0 if GUARD[kind] else text.rlike(BASE[kind])
    return F.when(guard, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def features(kind: str, span: Column) -> Column:
    """The features of a candidate, all doubles."""
    match, before = span["match"], span["before"]
    digits = digits_of(match)
    groups = F.filter(F.split(match, "[^0-9]+"), lambda g: g != "")
    parts = F.filter(F.split(match, "[^0-9A-Za-z]+"), lambda g: g != "")
    flags = {
        "kind": F.lit(KINDS.index(kind)),
        "length": F.length(match),
        "digits": F.length(digits),
        "groups": F.size(groups),
        "longest": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)),
        "parens": match.contains("("),
        "marks": F.length(F.regexp_replace(match, r"[0-9A-Za-z ]", "")),
        "luhn": F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False)),
        "hint": before.rlike(HINTS[kind]),
        "against": before.rlike(AGAINST),
        "date": match.rlike(r"^(?:(?:19|20)[0-9]{2}[-/.][01]?[0-9][-/.][0-3]?[0-9]|[0-3]?[0-9][-/.][01]?[0-9][-/.](?:19|20)[0-9]{2})\b"),
        "digit_share": F.length(digits) / F.length(match),
        "at_form": F.when(match.rlike(r"(?i)[(\[]at[)\]]"), 2).when(match.contains("@"), 1).otherwise(0),
        "dot_form": F.when(match.rlike(r"(?i)[(\[](?:dot|\.)[)\]]"), 3).when(match.rlike("(?i) dot "), 2).when(match.contains(". "), 0).otherwise(1),
        "ending": match.rlike(ENDING),
        "parts": F.size(parts),
        "widest": F.coalesce(F.array_max(F.transform(parts, F.length)), F.lit(0)),
        "leading": F.when(match.rlike(r"^\(?0"), 0).otherwise(F.coalesce(F.left(digits, F.lit(1)).try_cast("int"), F.lit(-1))),
        "breaks": F.length(F.regexp_replace(match, "[^ ]", "")),
        "brackets": match.contains("["),
        "double": match.rlike(r"::|  |--|\.\."),
    }
    return F.struct(*[flags[f].cast("double").alias(f) for f in FEATURES])


def candidates(text: Column, kind: str) -> Column:
    found = F.transform(located(text, LOOSE[kind]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), features(kind, s).alias("f")))
    kind_of = "array<struct<start:int,end:int,f:struct<" + ",".join(f"{f}:double" for f in FEATURES) + ">>>"
    return F.when(text.rlike(LOOSE[kind]), found).otherwise(F.array().cast(kind_of)).cast(kind_of)


#: Text before an example: for training and, after it, for calibration. "any" says nothing about the kind.
CONTEXTS = {
    "any": (["they saw ", "it was ", "and then ", "we have ", "see ", "in all "], ["there is ", "look: ", "note ", "so far "]),
    "phone": (["call me at ", "tel. ", "phone: ", "mobile ", "fax ", "ring ", "text me on ", "phone no. ", "my tel nr ", "call id "], ["dial ", "telefon ", "whatsapp ", "reach us under ", "cell "]),
    "email": (["contact ", "mail ", "write to ", "my email is ", "e-mail: "], ["reach me: ", "kontakt ", "send an email to "]),
    "ip": (["host ", "address ", "client ", "ip "], ["server ", "login from ", "gateway "]),
    "card": (["visa ", "credit card ", "payment card ", "card ", "card no. ", "my visa no "], ["mastercard: ", "debit ", "charge my card no "]),
    "number": (["order ", "invoice ", "version ", "section ", "total ", "id ", "token ", "isbn "], ["part ", "ticket ", "build ", "serial no ", "row ", "sum "]),
    "date": (["date ", "from 1999 to ", "on ", "born "], ["until ", "dated ", "the meeting of "]),
}
#: Forms of examples: kind, label, contexts, forms for training, forms added for calibration. In them 9 is a random
#: digit, 0 to 8 are themselves, X a hexadecimal digit, L, D and W names picked from ``NAMES``, A and P the signs
#: for "at" and "dot", and a final C the digit that passes (label 1) or fails (label 0) the Luhn check.
FORMS = [
    ("phone", 1, ["phone", "any"], ["(999) 999-9999", "999-999-9999", "0999 999 9999", "(0999) 999999", "0999/9999999", "0999-999-9999"], ["(099) 9999 9999", "0999 9999999", "099 999 99 99"]),
    ("phone", 1, ["phone"], ["9999999999", "999.999.9999", "099999999999", "999 999 999", "99 99 99 99 99", "999 999 9999"], ["0999.999999", "9999 999999", "99999999999"]),
    ("phone", 0, ["any", "number"], ["9999999999", "99 999 999", "99 99 99", "199 299 399", "9999 9999", "19.99.99", "99.99.9999", "999999 9999", "12 24 36 48"], ["999 999 999", "99 99 99 99", "9999.99.99"]),
    ("phone", 0, ["number"], ["99.99.99", "999-999-999", "999 999 9999", "999-99-999-9999"], ["99/99/999", "999-999-9999"]),
    ("phone", 0, ["date", "any", "phone"], ["2019-09-19", "19.09.2019", "2019/09/19", "19/09/2019", "1999-2009"], ["19-09-1999", "2029.09.19"]),
    ("phone", 0, ["card", "any", "number"], ["4999.9999.9999.999C", "5999/9999/9999/999C", "9999  9999  9999  9999", "3999.99999.9999C"], ["6999. 9999. 9999. 999C"]),
    ("email", 1, ["email", "any"], ["LADPW"], ["LADPDPW"]),
    ("email", 1, ["email", "any"], ["LADPDPW", "LADPDPDPW", "L @ D.W", "L@D . W"], ["LADPW", "L @ D.D.W"]),
    ("email", 0, ["any", "email", "number"], ["V at V. V", "V at V. The", "V at the V. But", "we met at V. So", "V @V. Then", "V at 9.99 V. It"], ["V at V dot V", "she was at V. He", "V @ V. Now"]),
    ("ip", 1, ["ip", "any"], ["199[.]99[.]99[.]99", "99[.]199[.]9[.]29", "2001:dXX:99:9:99:9:9:99", "199(.)99(.)99(.)99", "fe80::X9:XXXX", "2001:db8::XX:9", "99[dot]99[dot]99[dot]99"], ["2a0X:XXXX:9:9XX:9:X:9:XX", "19[.]168[.]9[.]19", "fd00::9XX:9"]),
    ("ip", 1, ["ip"], ["99 . 99 . 99 . 99", "199 .99 .99 .99"], ["19. 99. 99. 9"]),
    ("ip", 0, ["any", "number", "date"], ["9 . 9 . 9 . 9", "9. 9. 9. 9", "99. 99. 99. 99", "09:19:29:09:19", "XX:XX:XX:XX:XX:XX", "aX::bad", "a::X"], ["19. 29. 39. 49", "19:09:29:19:29", "add::fad"]),
    ("card", 1, ["card", "any"], ["4999.9999.9999.999C", "4999_9999_9999_999C", "5999/9999/9999/999C", "4999  9999  9999  999C", "3999.999999.9999C"], ["5999--9999--9999--999C", "4999. 9999. 9999. 999C", "6999/9999/9999/999C"]),
    ("card", 0, ["any", "number", "card"], ["4999.9999.9999.999C", "9999_9999_9999_999C", "5999/9999/9999/999C", "9999 999 999", "9999 9999 9999 999C"], ["9999.9999.9999", "9999  9999  9999  999C"]),
    ("card", 0, ["number", "date"], ["2019.09.19.9999", "1999.9999.9999", "9999 9999 9999"], ["2019-0919-9999"]),
]
NAMES = {
    "L": ["anna", "j.doe", "maria_k", "info", "b.smith42", "anna.b", "office", "peter-w", "x99"],
    "D": ["example", "mail", "uni-north", "web", "acme", "post", "corp9"],
    "W": ["com", "org", "net", "de", "fr", "info", "io", "co"],
    "V": ["looked", "noon", "home", "laughed", "him", "work", "night", "arrived", "school", "once", "cost", "station"],
    "A": ["(at)", " (at) ", "[at]", " [at] ", " at ", "(AT)"],
    "P": ["(dot)", " (dot) ", "[dot]", " [dot] ", " dot ", "."],
}


def picked(choices: Column, *salt) -> Column:
    """One of ``choices``, by the id and ``salt``."""
    return F.element_at(choices, (F.pmod(F.xxhash64("id", *salt), F.size(choices)) + 1).cast("int"))


def filled(form: Column, label: Column) -> Column:
    """An example of a form: letters and digits put in."""
    sign = lambda c: picked(F.array(*[F.lit(x) for x in NAMES[c]]), F.lit(c))  # noqa: E731 - one sign for the whole address

    def letter(c: Column, i: Column) -> Column:
        out = F.when(c == "9", F.pmod(F.xxhash64("id", i), F.lit(10)).cast("string")).when(c == "X", F.lower(F.hex(F.pmod(F.xxhash64("id", i), F.lit(16)))))
        for name in "LDWV":
            out = out.when(c == name, picked(F.array(*[F.lit(x) for x in NAMES[name]]), i, F.lit(name)))
        # the spelled "at" with a plain point reads like prose and is no example
        return out.when(c == "A", sign("A")).when(c == "P", F.when((sign("A") == " at ") & (sign("P") == "."), F.lit(" dot ")).otherwise(sign("P"))).otherwise(c)

    made = F.array_join(F.transform(F.split(form, ""), letter), "")
    stem = F.rtrim(made, F.lit("C"))
    passing = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: luhn(digits_of(F.concat(stem, d.cast("string")))))[0]
    return F.when(form.endswith("C"), F.concat(stem, F.pmod(passing + F.when(label == 1, 0).otherwise(3), F.lit(10)).cast("string"))).otherwise(made)


def examples(spark: SparkSession) -> DataFrame:
    """Labelled candidates: kind features, label, and whether they calibrate instead of train.

    Only a candidate that covers its whole example is labelled by it; others around it are left out, and
    so are those of a negative that the generator does not propose.
    """
    rows = []
    for kind, label, contexts, forms, more in FORMS:
        for held_out, these in ((False, forms), (True, forms + more)):
            before = [b for c in contexts for b in CONTEXTS[c][held_out]]
            rows.append(F.struct(F.lit(kind).alias("k"), F.lit(label).alias("y"), F.lit(held_out).alias("held_out"), F.array(*[F.lit(b) for b in before]).alias("before"), F.array(*[F.lit(f) for f in these]).alias("forms")))
    recipes = spark.range(0, EXAMPLES, 1, 2).withColumn("r", F.array(*rows)[(F.col("id") % len(rows)).cast("int")])
    chosen = recipes.select("id", "r.k", "r.y", "r.held_out", picked(F.col("r.before"), F.lit("b")).alias("before"), picked(F.col("r.forms"), F.lit("f")).alias("form"))
    texts = chosen.select("id", "k", "y", "held_out", "before", filled(F.col("form"), F.col("y")).alias("made"))
    each = []
    for kind in KINDS:
        one = texts.where(F.col("k") == kind).withColumn("text", F.concat(F.lit("So far "), "before", "made", F.lit(", and more")))
        at = F.length("before") + 7
        each.append(one.select("held_out", "y", at.alias("at"), (at + F.length("made")).alias("to"), F.explode(candidates(F.col("text"), kind)).alias("c")))
    found = reduce(DataFrame.unionByName, each)
    whole = (F.col("c.start") == F.col("at")) & (F.col("c.end") == F.col("to"))
    return found.where(whole | (F.col("y") == 0)).select(F.col("y").cast("double").alias("label"), "held_out", "c.f.*").coalesce(2)


def as_tree(node) -> tuple | float:
    """A decision tree as (feature, threshold, low, high) tuples and leaves."""
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return FEATURES[split.featureIndex()], float(split.threshold()), as_tree(node.leftChild()), as_tree(node.rightChild())


def as_column(tree: tuple | float, f: Column, kind: str | None) -> Column:
    """A decision tree as nested CASE expressions; with a known ``kind`` its splits are already taken."""
    if isinstance(tree, float):
        return F.lit(tree)
    name, threshold, low, high = tree
    if name == "kind" and kind:
        return as_column(low if KINDS.index(kind) <= threshold else high, f, kind)
    return F.when(f[name] <= threshold, as_column(low, f, kind)).otherwise(as_column(high, f, kind))


class Scorer:
    """Trees and thresholds, trained once a session."""

    of: dict[str, "Scorer"] = {}

    def __init__(self, spark: SparkSession):
        rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(examples(spark)).cache()
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(rows.where("not held_out"))
        self.trees = [(float(w), as_tree(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees)]
        f = F.struct(*FEATURES)
        judged = rows.where("held_out").select("kind", "label", self.score(f).alias("score")).collect()  # a few for each of EXAMPLES at most
        rows.unpersist()
        self.thresholds = {}
        for i, kind in enumerate(KINDS):
            own = sorted((-r["score"], r["label"]) for r in judged if r["kind"] == i)
            right, best = 0.0, 1.1
            for n, (score, label) in enumerate(own, 1):
                right += label
                if right / n >= PRECISION and (n == len(own) or own[n][0] > score):
                    best = -score
            self.thresholds[kind] = max(0.5, best)

    def score(self, f: Column, kind: str | None = None) -> Column:
        """Probability that a candidate with features ``f`` is personal data."""
        raw = reduce(lambda a, b: a + b, [F.lit(w) * as_column(root, f, kind) for w, root in self.trees])
        return 1 / (1 + F.exp(-2 * raw))

    @classmethod
    def get(cls, spark: SparkSession) -> "Scorer":
        key = spark.sparkContext.applicationId
        if key not in cls.of:
            cls.of[key] = cls(spark)
        return cls.of[key]


def best_of(spans: Column) -> Column:
    """The added spans among ``spans``, which are in order of start: one sweep, in which the better of two overlapping spans stays.

    Fixed spans have probability ``FIXED``, so they beat all others; they are not returned. A span that
    lost to one that loses in turn comes back if it ends before the winner starts.
    """
    state = f"struct<now:{CHOICE},lost:{CHOICE},some:array<{CHOICE}>,full:array<array<{CHOICE}>>>"
    nobody, none = F.lit(None).cast(CHOICE), F.array().cast(f"array<{CHOICE}>")
    whole = lambda now, lost, some, full: F.struct(now.alias("now"), lost.alias("lost"), some.alias("some"), full.alias("full")).cast(state)
    wins = lambda c: c.isNotNull() & (c["p"] < FIXED)

    def keep(acc: Column, c: Column, out: Column) -> tuple[Column, Column]:
        """``some`` and ``full`` with ``c`` where ``out``; spans gather in blocks, so that appending stays cheap."""
        room = F.size(acc["some"]) < 256
        some = F.when(~out, acc["some"]).when(room, F.concat(acc["some"], F.array(c))).otherwise(F.array(c))
        return some, F.when(~out | room, acc["full"]).otherwise(F.concat(acc["full"], F.array(acc["some"])))

    def step(acc: Column, c: Column) -> Column:
        now, lost = acc["now"], acc["lost"]
        apart = now.isNull() | (now["end"] <= c["start"])
        both = (now["p"] == FIXED) & (c["p"] == FIXED)
        further = F.struct(now["start"].alias("start"), F.greatest(now["end"], c["end"]).alias("end"), now["p"].alias("p"), now["kind"].alias("kind")).cast(CHOICE)
        back = lost.isNotNull() & (lost["end"] <= c["start"])
        return (
            F.when(apart, whole(c, nobody, *keep(acc, now, F.coalesce(wins(now), F.lit(False)))))
            .when(both, whole(further, lost, acc["some"], acc["full"]))
            .when(c["p"] > now["p"], whole(c, F.when(back, nobody).otherwise(now), *keep(acc, lost, F.coalesce(back, F.lit(False)))))
            .otherwise(whole(now, lost, acc["some"], acc["full"]))
        )

    last = lambda acc: F.when(wins(acc["now"]), F.array(acc["now"])).otherwise(none)
    return F.aggregate(spans, whole(nobody, nobody, none, F.array().cast(f"array<array<{CHOICE}>>")), step, lambda acc: F.concat(F.flatten(acc["full"]), acc["some"], last(acc)))


def find(docs: DataFrame, *, text: str = "text", carry: list[str] | None = None, out: str = "pii") -> tuple[DataFrame, str]:
    """The ``carry`` columns (default: all) with a struct of span arrays, ``base`` and ``spans`` by kind, in a new column; returns its name too."""
    scorer, out = Scorer.get(docs.sparkSession), fresh(docs, out)
    body = F.coalesce(F.col(text), F.lit(""))
    step = docs.select(F.struct(*(carry or docs.columns)).alias("row"), body.alias("t"))
    step = step.select("row", "t", *[fixed_spans(F.col("t"), k).alias(f"b_{k}") for k in KINDS])
    step = step.select("*", *[candidates(F.col("t"), k).alias(f"c_{k}") for k in KINDS])
    fixed = F.concat(*[F.transform(f"b_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS])
    step = step.select("row", *[f"b_{k}" for k in KINDS], *[f"c_{k}" for k in KINDS], fixed.alias("fixed"))

    def chosen(kind: str) -> Column:
        scored = F.transform(f"c_{kind}", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), scorer.score(c["f"], kind).alias("p"), F.lit(kind).alias("kind")).cast(CHOICE))
        return F.filter(scored, lambda c: c["p"] >= scorer.thresholds[kind])

    none = F.array().cast(f"array<{CHOICE}>")
    more = F.when(F.size(F.concat(*[f"c_{k}" for k in KINDS])) > 0, F.concat(*[chosen(k) for k in KINDS])).otherwise(none)
    step = step.select("row", *[f"b_{k}" for k in KINDS], "fixed", more.alias("more"))
    fixed = F.transform("fixed", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.lit(FIXED).alias("p"), F.lit("").alias("kind")).cast(CHOICE))
    step = step.select("row", *[f"b_{k}" for k in KINDS], F.when(F.size("more") > 0, F.array_sort(F.concat("more", fixed))).otherwise(none).alias("all"))
    step = step.select("row", *[f"b_{k}" for k in KINDS], best_of(F.col("all")).alias("added"))

    def line(kind: str, spans: Column) -> Column:
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        return F.transform(ordered, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    added = lambda kind: F.transform(F.filter("added", lambda c: c["kind"] == kind), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit("").alias("match"), F.lit("").alias("before")).cast(SPAN))
    found = F.struct(
        *[F.size(f"b_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.concat(*[line(k, F.col(f"b_{k}")) for k in KINDS]).alias("base"),
        F.concat(*[line(k, F.concat(F.col(f"b_{k}"), added(k))) for k in KINDS]).alias("spans"),
    )
    return step.select("row.*", found.alias(out)), out


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, out = find(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return found.select(
        "doc_id", *[F.col(out)[f"n_{k}"].alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join(F.col(out)["base"], ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.col(out)["spans"], ",").alias("spans")
    )
