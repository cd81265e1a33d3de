"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Training sums n, x and x x' per class over every labelled training text (partial sums per task,
so that only two small matrices reach the driver). Features are rounded to 1 / GRID for that and
summed as whole numbers, so that the model doesn't hang on the order of sums. Each class covariance is shrunk towards the
pooled covariance and towards a multiple of the identity, and its Cholesky factor is computed
once. A score is the logistic of the difference of the Mahalanobis log densities plus the log
prior odds.

Null or empty text: statistics of a text without words, scored like any other. Labels that are
null, or whose text is absent, teach nothing; where an id has several labels their mean counts,
0.5 and above as 1. If a class has no training text, every score is the prior of label 1 (0.5
without any label). Repeated rows are scored each; columns other than ``doc_id`` and ``text``
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom import bloom_of
from .common import cut, map_rows, portions
from .measures import COUNTS_DDL, count_batch

N_FEATURES = 11
GRID = 1 << 16
THRESHOLD = 0.7


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Transformed statistics, one row per text: logs of smoothed rates, so that tails are tame."""
    n = c["n_words"].astype(float)
    letters = c["n_upper"] + c["n_lower"] + 1.0
    rate = lambda x, of, eps: np.log((x + eps) / (of + 1.0) + eps)
    return np.stack(
        [
            np.log(n + 1.0) / 3,
            rate(c["n_symbols"], n, 0.02),
            rate(c["n_upper"], letters, 0.02),
            np.log((c["word_chars"] + 5.0) / (n + 1.0)),
            rate(c["n_repeat_words"], n, 0.02),
            rate(c["n_dup_lines"], c["n_lines"], 0.05),
            rate(c["n_digits"], c["word_chars"], 0.01),
            rate(c["n_stops"], n, 0.02),
            rate(c["n_bangs"], n, 0.02),
            rate(c["n_distinct_words"], n, 0.02),
            rate(c["n_same_next"], n, 0.02),
        ],
        axis=1,
    )


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log normalisers of class 0 and 1, and the log prior odds."""

    means: np.ndarray
    factors: np.ndarray
    norms: np.ndarray
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.log_odds)
        for k, sign in ((0, -1), (1, 1)) if len(self.means) else ():
            y = (x - self.means[k]) @ self.factors[k].T
            z += sign * (self.norms[k] - 0.5 * (y * y).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, to_pooled: float, to_identity: float) -> Discriminant:
    """From each class's number of texts, sum of x and sum of x x'."""
    if min(n) < 1:
        odds = np.log(n[1] + 1.0) - np.log(n[0] + 1.0)
        return Discriminant(np.empty((0,)), np.empty((0,)), np.empty((0,)), float(odds))
    means = sums / n[:, None]
    scatter = squares - n[:, None, None] * np.einsum("ki,kj->kij", means, means)
    pooled = scatter.sum(axis=0) / max(n.sum() - 2, 1)
    d = len(pooled)
    factors, norms = [], []
    for k in (0, 1):
        own = scatter[k] / max(n[k] - 1, 1)
        mixed = (1 - to_pooled) * own + to_pooled * pooled
        mixed = (1 - to_identity) * mixed + to_identity * max(np.trace(mixed) / d, 1e-6) * np.eye(d)
        low = np.linalg.cholesky((mixed + mixed.T) / 2)
        factors.append(np.linalg.inv(low))
        norms.append(-np.log(np.diag(low)).sum())
    return Discriminant(means, np.stack(factors), np.array(norms), float(np.log(n[1]) - np.log(n[0])))


def feature_lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_FEATURES), type=pa.int32()), pa.array(x.ravel(), type=pa.float64()))


def text_features(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``, the features of each text."""

    return map_rows(docs.select("doc_id", "text"), lambda batch: {"x": feature_lists(features(count_batch(batch)))}, ["doc_id"], "x array<double>")


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text falls on the held-out remainder; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, y) of the labelled ids that are not held out."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))


def train(featured: DataFrame, wanted: DataFrame, to_pooled: float = 0.1, to_identity: float = 0.02) -> Discriminant:
    """Fit on the texts that ``wanted`` (doc_id, y) has."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.zeros((2, 1 + N_FEATURES + N_FEATURES**2), object)  # whole numbers of any size
        for b in batches:
            x = np.rint(np.asarray(b.column("x").flatten()).reshape(-1, N_FEATURES) * GRID).astype(np.int64)
            y = np.asarray(b.column("y"))
            for k in (0, 1):
                own = x[y == k]
                flat[k] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel())).astype(object)
        rows = [(k, i, Decimal(int(v))) for k in (0, 1) for i, v in enumerate(flat[k])]
        y, i, v = zip(*rows, strict=True)
        yield pa.RecordBatch.from_pydict({"y": pa.array(y, pa.int32()), "i": pa.array(i, pa.int32()), "v": pa.array(v, pa.decimal128(38, 0))})

    parts = featured.join(wanted, "doc_id").select("x", "y").mapInArrow(sums, "y int, i int, v decimal(38,0)")
    totals = parts.groupBy("y", "i").agg(F.sum("v").alias("v")).collect()  # 2 * (1 + d + d * d) numbers
    flat = np.zeros((2, 1 + N_FEATURES + N_FEATURES**2))
    d = N_FEATURES
    scale = np.repeat([1.0, GRID, float(GRID) ** 2], [1, d, d * d])
    for r in totals:
        flat[r["y"], r["i"]] = float(r["v"]) / scale[r["i"]]
    return fit(flat[:, 0], flat[:, 1 : 1 + d], flat[:, 1 + d :].reshape(2, d, d), to_pooled, to_identity)


def score_features(featured: DataFrame, model: Discriminant) -> DataFrame:
    def kernel(batch: pa.RecordBatch) -> dict:
        return {"score": model.score(np.asarray(batch.column("x").flatten()).reshape(-1, N_FEATURES))}

    return map_rows(featured, kernel, ["doc_id"], "score double")


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``."""
    featured = cut(text_features(docs))
    scored = score_features(featured, train(featured, training_labels(labels)))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score reaches ``threshold``."""
    wanted = cut(training_labels(labels).withColumn("_k", F.xxhash64("doc_id")))
    # A Bloom filter names the labelled texts, so that no text moves; the join in ``train`` drops what it errs on.
    sent = docs.sparkSession.sparkContext.broadcast(bloom_of(wanted, "_k", wanted.count()))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            b = b.filter(pa.array(sent.value.has(b.column("_k").to_numpy().view(np.uint64))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), feature_lists(features(count_batch(b)))], names=["doc_id", "x"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("x", T.ArrayType(T.DoubleType()))])
    featured = cut(docs.select("doc_id", "text", F.xxhash64("doc_id").alias("_k")).mapInArrow(labelled, schema))
    model = train(featured, wanted.drop("_k"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            yield b.filter(pa.array(model.score(features(count_batch(b))) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
