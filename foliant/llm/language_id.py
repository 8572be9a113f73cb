"""Language identification by word-first backoff.

A known word scores its log frequency in each language; an unseen word falls back to character
n-grams, longest first, and every n-gram that is unknown falls back to its two shorter parts. The
language with the largest total wins.

Learning counts words by language in Spark over a sample of at most ``max_docs`` labelled documents
a language (chosen by a hash of the id and text, whole texts); the model, which is broadcast, knows all
words and n-grams of the sample and so is bounded by it. Prediction is one narrow pass over all whole
texts. Words are runs of letters (Unicode category L) in both.

Defined cases: a null text or one without a letter is ``und`` with score 0; documents with a null
language are not learned from; a null id is not held out; with nothing to learn from every document
is ``und``; equal totals go to the first language in order; repeated rows are judged one by one.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import doc_bucket, table

MAX_DOCS = 2_000
LONGEST = 4
FOLDS, HELD_OUT = 4, 2
UNDETERMINED = "und"
#: Words of the pooled distribution that each language's counts are smoothed with.
PRIOR = 100.0
#: Words whose scores a Python worker remembers.
CACHE = 400_000

#: Folds A-Z and turns ASCII other than letters into spaces.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = regex.compile(r"\p{L}+")


class Counts:
    """Log frequencies by string and language."""

    def __init__(self, keys: list[str], counts: np.ndarray):
        self.row = {k: i for i, k in enumerate(keys)}
        pooled = counts.sum(axis=1, keepdims=True) / max(1.0, counts.sum())  # what a language with few words is smoothed towards
        self.logs = np.log((counts + PRIOR * pooled) / (counts.sum(axis=0) + PRIOR)) if keys else counts

    def get(self, key: str) -> np.ndarray | None:
        at = self.row.get(key)
        return None if at is None else self.logs[at]


class Model:
    """Log frequencies by word, and by n-gram for each length."""

    def __init__(self, langs: list[str], words: tuple[list[str], np.ndarray], grams: tuple[list[str], np.ndarray]):
        self.langs, self.words = langs, Counts(*words)
        lengths = np.array([len(g) for g in grams[0]])
        each = [np.flatnonzero(lengths == n) for n in range(1, LONGEST + 1)]
        self.grams = [Counts([grams[0][i] for i in at], grams[1][at]) for at in each]

    def gram(self, g: str) -> np.ndarray | None:
        """Score of an n-gram: its own or the mean of its two shorter parts."""
        if (own := self.grams[len(g) - 1].get(g)) is not None or len(g) == 1:
            return own
        parts = [x for x in (self.gram(g[:-1]), self.gram(g[1:])) if x is not None]
        return sum(parts) / len(parts) if parts else None

    def word(self, w: str) -> np.ndarray:
        if (own := self.words.get(w)) is not None:
            return own
        marked = f"^{w}$"
        n = min(LONGEST, len(marked))
        parts = [x for i in range(len(marked) - n + 1) if (x := self.gram(marked[i : i + n])) is not None]
        return sum(parts) / len(parts) if parts else np.zeros(len(self.langs))


class Rows(dict):
    """Runs of letter bytes -> rows of a growing matrix; row 0 is for runs without a letter."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.matrix = np.zeros((1024, max(1, len(model.langs))))
        self.used = 1

    def __missing__(self, run: bytes) -> int:
        words = WORD.findall(run.decode().lower())
        at = self.used if words else 0
        if words:
            if at == len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            self.matrix[at] = sum(self.model.word(w) for w in words)
            self.used += 1
        self[run] = at
        return at


class Predictor:
    """Scores whole texts: ASCII other than letters splits runs, what else a run holds is told apart when it is new."""

    def __init__(self, model: Model):
        self.model, self.rows = model, Rows(model)

    def predict(self, text: bytes | None) -> tuple[str, float]:
        if not self.model.langs:
            return UNDETERMINED, 0.0
        if len(self.rows) > CACHE:
            self.rows = Rows(self.model)
        ids = np.array([*map(self.rows.__getitem__, text.translate(LETTERS).split())] if text else [], np.int64)
        if not ids.any():
            return UNDETERMINED, 0.0
        total = sum(self.rows.matrix[ids[at : at + 65536]].sum(axis=0) for at in range(0, len(ids), 65536))
        best = int(total.argmax())
        return self.model.langs[best], float(1 / np.exp(total - total[best]).sum())


def sample(docs: DataFrame, doc_id: str, text: str, lang: str, max_docs: int) -> DataFrame:
    """About ``max_docs`` labelled documents of each language at most, by hash."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    share = known.groupBy("lang").agg(F.least(F.lit(1.0), max_docs / F.count("*")).alias("share"))
    hashed = F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000))
    # one row a language
    return known.join(F.broadcast(share), "lang").where(hashed < F.col("share") * 1_000_000).select("lang", "text")


def fit(labelled: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = MAX_DOCS) -> Model:
    learned = sample(labelled, doc_id, text, lang, max_docs)
    words = learned.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''").groupBy("lang", "word").count().cache()
    try:
        langs = sorted(r[0] for r in words.select("lang").distinct().collect())
        columns = [F.sum(F.when(F.col("lang") == x, F.col("count")).otherwise(0)).alias(f"c{i}") for i, x in enumerate(langs)]

        def wide(counted: DataFrame, key: str) -> tuple[list[str], np.ndarray]:
            if not langs:
                return [], np.zeros((0, 1))
            found = counted.groupBy(key).agg(*columns).toArrow()  # bounded by the sample
            return found[key].to_pylist(), np.stack([found[f"c{i}"].to_numpy() for i in range(len(langs))], 1).astype(float)

        marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
        spans = F.flatten(F.array(*[
            F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(marked) - n + 1)), lambda i, n=n: F.substring(marked, i, F.lit(n))) for n in range(1, LONGEST + 1)
        ]))
        grams = words.select("lang", "count", F.explode(spans).alias("gram"))
        return Model(langs, wide(words, "word"), wide(grams, "gram"))
    finally:
        words.unpersist()


_PREDICTORS: dict[str, Predictor] = {}


def predict_udf(spark: SparkSession, model: Model):
    sent, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        if key not in _PREDICTORS:
            _PREDICTORS.clear()
            _PREDICTORS[key] = Predictor(sent.value)
        found = [_PREDICTORS[key].predict(x) for x in texts.cast(pa.binary()).to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["lang", "score"])

    return predict


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = doc_bucket("doc_id", FOLDS) == HELD_OUT
    model = fit(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), predict_udf(spark, model)("text").alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
