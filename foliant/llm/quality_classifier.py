"""Quality classifier: nearest-neighbour voting in a latent semantic space.

Texts become weighted counts of hashed features: folded words, the shapes of words (case, digits and
marks) and how varied the words are. From a bounded sample of labelled documents (``per_label`` of
each label at most, by hash) the driver computes inverse document frequencies and a truncated
singular value decomposition. The labelled vectors, ``2 * per_label`` rows of ``rank`` numbers, are
broadcast; every document is projected and meets all of them in exact blocked cosine products, and
its ``neighbours`` nearest vote with their similarities. A share of votes is no probability: it hangs on
how many samples each label has. So every labelled vector is also scored by its neighbours but itself, and
the share that parts the labels best, both counted alike, becomes the score ``threshold``; scores below and above
are stretched evenly, which keeps their order.

Scoring is one narrow pass over whole texts: no shuffle of documents, and memory bounded by a block.

Defined cases: a null or empty text has no features and scores the labels' mean; labels without a
document, null labels and null ids are not learned from; with only one label known every document
scores it, with none 0.5, and shares stay as they are; equal similarities go to the earlier vector; repeated rows are scored one
by one; other columns are kept as they are.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import doc_bucket, fresh, table

PER_LABEL = 1_000
RANK = 48
NEIGHBOURS = 25
DIMS = 1 << 14
BLOCK = 256
#: Features of the samples that are a dense matrix at once.
CHUNK = 1 << 10
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
#: Words whose features a Python worker remembers.
CACHE = 250_000

#: Maps bytes to classes: capitals, small and non-ASCII letters, digits; other bytes stay.
SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))


def shape(word: bytes) -> bytes:
    """Classes of a word's bytes with runs shortened: ``THE!!`` is ``A!``."""
    classes = word.translate(SHAPE)
    return bytes(b for i, b in enumerate(classes) if not i or b != classes[i - 1])[:8]


class Features(dict):
    """Word -> (word feature, shape feature)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        found = zlib.crc32(b"w" + word.lower()) % DIMS << 14 | zlib.crc32(b"s" + shape(word)) % DIMS
        self[word] = found
        return found

    def of(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and weights of a text; shapes and variety weigh as much as the words together."""
        words = text.split() if text else []
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        each = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        packed, times = np.unique(each, return_counts=True)
        counts = np.bincount(packed >> 14, times, DIMS)
        shapes = np.bincount(packed & (DIMS - 1), times, DIMS)
        variety = zlib.crc32(b"v%d" % int(8 * len(packed) / len(words))) % DIMS
        shapes[variety] += 0.2 * len(words)
        stutter = int((each[1:] == each[:-1]).sum())
        if stutter:
            shapes[zlib.crc32(b"r%d" % int(8 * stutter / len(words))) % DIMS] += min(len(words), 4 * stutter)
        out = np.log1p(counts)
        out /= np.sqrt((out**2).sum())
        out += shapes / np.sqrt((shapes**2).sum())
        ids = out.nonzero()[0]
        return ids, out[ids]


def leading(gram: np.ndarray, rank: int, turns: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, with their vectors, by subspace iteration from a fixed start."""
    n = len(gram)
    basis = np.linalg.qr(np.random.default_rng(48).standard_normal((n, min(n, 2 * rank))))[0].astype(np.float32)
    for _ in range(turns):
        basis = np.linalg.qr(gram @ basis)[0]
    values, within = np.linalg.eigh((basis.T @ gram @ basis).astype(np.float64))
    order = np.argsort(-values)[:rank]
    return values[order], basis @ within[:, order]


class Model:
    """Projection to the latent space and the labelled unit vectors in it.

    ``ids`` and ``weights`` are the features of all samples, one after another, and ``starts`` where each sample's
    begin (one more than samples). Matrices are dense for ``CHUNK`` features at a time only.
    """

    def __init__(self, ids: np.ndarray, weights: np.ndarray, starts: np.ndarray, labels: np.ndarray, rank: int):
        n = len(labels)
        self.labels = labels.astype(np.float32)
        self.base = float(self.labels.mean()) if n else 0.5
        idf = (np.log((1 + n) / (1 + np.bincount(ids, minlength=DIMS))) + 1).astype(np.float32)
        row, weights = np.repeat(np.arange(n), np.diff(starts)), weights.astype(np.float32)
        order = np.argsort(ids, kind="stable")
        row, columns, values = row[order], ids[order], (weights * idf[ids])[order]
        bounds = np.searchsorted(columns, np.arange(0, DIMS + 1, CHUNK))

        def chunks():
            for lo, i, j in zip(range(0, DIMS, CHUNK), bounds[:-1], bounds[1:]):
                dense = np.zeros((n, CHUNK), np.float32)
                dense[row[i:j], columns[i:j] - lo] = values[i:j]
                yield lo, dense

        gram = np.zeros((n, n), np.float32)
        for _, dense in chunks():
            gram += dense @ dense.T
        strength, left = leading(gram, rank)
        keep = np.flatnonzero(strength > 1e-6)
        basis = (left[:, keep] / np.sqrt(strength[keep])).astype(np.float32)
        self.projection = np.zeros((DIMS, len(keep)), np.float32)
        for lo, dense in chunks():
            self.projection[lo : lo + CHUNK] = idf[lo : lo + CHUNK, None] * (dense.T @ basis)
        latent = [self.projection[ids[i:j]].T @ weights[i:j] for i, j in zip(starts[:-1], starts[1:])]
        self.vectors = unit(np.array(latent, np.float32).reshape(n, len(keep)))
        #: The share of votes that becomes the score ``at``.
        self.cut = self.at = 0.5

    def votes(self, docs: np.ndarray, neighbours: int, own: np.ndarray | None = None) -> np.ndarray:
        """Shares of votes for label 1 among the nearest samples of unit vectors; ``own``: for each a sample that has no vote."""
        # rounded, so that products of blocks of other shapes tie alike
        cosine = np.round(docs @ self.vectors.T, 5)
        k = min(neighbours, len(self.labels))
        if own is not None:
            cosine[np.arange(len(docs)), own] = -2
            k = min(k, len(self.labels) - 1)
        least = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
        near, tied = cosine > least, cosine == least
        near |= tied & (np.cumsum(tied, axis=1) <= k - near.sum(axis=1, keepdims=True))
        weight = np.where(near, np.maximum(cosine, 0) + 1e-9, 0).astype(np.float64)
        return np.clip((weight @ self.labels) / weight.sum(axis=1), 0.0, 1.0)

    def calibrate(self, neighbours: int, at: float) -> None:
        """Find the share of votes that parts the labels best; of shares that part them alike the middle of the widest gap."""
        positive = self.labels > 0
        if positive.all() or not positive.any() or not self.vectors.shape[1]:
            return
        shares = np.concatenate([self.votes(self.vectors[i : i + BLOCK], neighbours, np.arange(i, min(i + BLOCK, len(positive)))) for i in range(0, len(positive), BLOCK)])
        values = np.concatenate([[0.0], np.unique(shares), [1.0]])
        wrong = lambda cut: (shares[positive] < cut).mean() + (shares[~positive] >= cut).mean()
        best = min(zip(values[:-1], values[1:]), key=lambda gap: (round(wrong(sum(gap) / 2), 9), gap[0] - gap[1]))
        self.cut, self.at = float(np.clip(sum(best) / 2, 1e-3, 1 - 1e-3)), at

    def scores(self, found: list[tuple[np.ndarray, np.ndarray]], neighbours: int) -> np.ndarray:
        out = np.full(len(found), self.base)
        if not len(self.labels) or not self.vectors.shape[1]:
            return out
        docs = unit(np.array([self.projection[i].T @ w.astype(np.float32) for i, w in found], np.float32))
        empty = (docs == 0).all(axis=1)
        share = self.votes(docs, neighbours)
        score = np.where(share < self.cut, self.at * share / self.cut, self.at + (1 - self.at) * (share - self.cut) / (1 - self.cut))
        out[~empty] = score[~empty]
        return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows**2).sum(axis=1, keepdims=True)), 1e-12)


def features_udf():
    @F.arrow_udf("struct<ids:array<int>,weights:array<double>>")
    def features(texts: pa.Array) -> pa.Array:
        known = Features()
        found = [known.of(x) for x in texts.cast(pa.binary()).to_pylist()]
        return pa.StructArray.from_arrays([pa.array([i for i, _ in found], pa.list_(pa.int32())), pa.array([w for _, w in found], pa.list_(pa.float64()))], names=["ids", "weights"])

    return features


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", where: Column | None = None, per_label: int = PER_LABEL, rank: int = RANK, neighbours: int = NEIGHBOURS, threshold: float = THRESHOLD) -> Model:
    """Learn from the labels that ``where`` (over their id, default: all) allows; ``threshold`` becomes the score that parts them."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(where) if where is not None else known
    counts = dict(known.groupBy("label").count().collect())  # two rows
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col("label") == value, F.lit(1e6 * per_label / n)).otherwise(share)
    chosen = known.where(hashed < share).dropDuplicates()  # about 2 x per_label rows
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())
    features = features_udf().asNondeterministic()  # so that the filter behind it does not go below the join, to all documents
    found = texts.select("doc_id", "label", features("text").alias("f")).select("doc_id", "label", "f.ids", "f.weights").where(F.size("ids") > 0)
    found = found.toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    flat = lambda c: pc.list_flatten(found[c].combine_chunks()).to_numpy(zero_copy_only=False)
    starts = np.cumsum([0, *pc.list_value_length(found["ids"]).to_pylist()])
    model = Model(flat("ids").astype(np.int64), flat("weights"), starts, found["label"].to_numpy(), rank)
    model.calibrate(neighbours, threshold)
    return model


_STATE: dict[str, Features] = {}


def score_udf(spark: SparkSession, model: Model, neighbours: int):
    sent, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if key not in _STATE:
            _STATE.clear()
            _STATE[key] = Features()
        out = []
        for at in range(0, len(texts), BLOCK):
            raw = texts.slice(at, BLOCK).cast(pa.binary()).to_pylist()
            out.append(sent.value.scores([_STATE[key].of(x) for x in raw], neighbours))
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return score


def score(docs: DataFrame, model: Model, *, text: str = "text", neighbours: int = NEIGHBOURS, out: str = "score") -> tuple[DataFrame, str]:
    """``docs`` with their scores in a new column; returns its name too."""
    out = fresh(docs, out)
    return docs.withColumn(out, score_udf(docs.sparkSession, model, neighbours)(F.col(text))), out


def learnable() -> Column:
    return doc_bucket("doc_id", FOLDS) != HELD_OUT


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, with their own columns."""
    scored, out = score(docs, fit(docs, labels, where=learnable()))
    return scored.where(F.col(out) >= threshold).drop(out)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), where=learnable())
    scored, out = score(docs, model)
    return scored.select("doc_id", (doc_bucket("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col(out).alias("score"), (F.col(out) >= THRESHOLD).cast("int").alias("predicted"))
