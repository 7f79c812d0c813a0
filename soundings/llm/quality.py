"""Quality by regularised quadratic discriminant analysis.

Each text becomes a short vector of transformed statistics: shares of symbols, capitals,
digits and repeats as smoothed log-odds, lengths as logarithms.  Each class has its own
mean and covariance, shrunk towards a sphere, and its Cholesky factor is kept; the score is
the logistic of the difference of the two log-densities,
``-|L^-1 (x - m)|^2 / 2 - log det L + log prior``.

Smoothing draws a short text's shares towards usual ones, so that few words decide
little.  Vectors are clipped to a few deviations for the same reason.
"""
from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from soundings.llm.text import text_runs
from soundings.session import cut_lineage

SHRINKAGE = 0.1
CLIP = 6.0
THRESHOLD = 0.3

_LETTERS = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_WHITE = [9, 10, 11, 12, 13, 32]

#: Statistic: usual share, and how many units of it a text is thought to have seen already.
USUAL = {
    "symbols": (0.003, 60), "capitals": (0.04, 60), "digits": (0.003, 60), "stops": (0.12, 25),
    "doubled words": (0.01, 25), "repeated lines": (0.03, 4), "exclamations": (0.001, 60), "bars": (0.001, 60),
    "distinct words": (0.7, 25), "lone signs": (0.005, 25),
}
LOGS = ["word length", "spread of word length", "words a line"]
FEATURES = [*USUAL, *LOGS]


def statistics(text: bytes) -> list[float]:
    """The vector of one text, in the order of ``FEATURES``; also defined for the empty text."""
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    sizes = np.fromiter(map(len, words), np.float64, len(words))
    lines = [line for line in text.split(b"\n") if line.strip()]
    letters, capitals, digits, stops = seen[_LETTERS].sum(), seen[65:91].sum(), seen[48:58].sum(), seen[[44, 46]].sum()
    n, w = len(text), len(words)
    symbols = n - letters - digits - stops - seen[_WHITE].sum()
    counts = {
        "symbols": (symbols, n), "capitals": (capitals, letters), "digits": (digits, n), "stops": (stops, w + stops),
        "doubled words": (sum(map(eq, words, words[1:])), w), "repeated lines": (len(lines) - len(set(lines)), len(lines)),
        "exclamations": (seen[33], n), "bars": (seen[124], n), "distinct words": (len(set(words)), w),
        "lone signs": (int((sizes == 1).sum()), w),
    }
    out = []
    for name, (share, weight) in USUAL.items():
        part, whole = counts[name]
        out.append(float(np.log((part + share * weight) / (whole - part + (1 - share) * weight))))
    mean = (sizes.sum() + 6 * 10) / (w + 10)
    spread = (((sizes - mean) ** 2).sum() + 12 * 10) / (w + 10)
    return [*out, float(np.log(mean)), float(np.log(spread) / 2), float(np.log((w + 40) / (len(lines) + 1)))]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_runs(batches):
        vectors = pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), vectors], ["doc_id", "vector"])


def document_vectors(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_vectors, "doc_id long, vector array<double>")


def remainder(column: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by


class Discriminant:
    """Class means, cached Cholesky factors and log priors in standardised coordinates."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE):
        """``moments``: by class the number of rows, their sum and the sum of their outer products."""
        d = len(FEATURES)
        n = sum(m[0] for m in moments.values())
        self.mean, self.scale, self.classes = np.zeros(d), np.ones(d), {}
        if n:
            self.mean = sum(m[1] for m in moments.values()) / n
            self.scale = np.sqrt(np.maximum(np.diag(sum(m[2] for m in moments.values())) / n - self.mean ** 2, 1e-6))
        for label, (rows, total, products) in moments.items():
            mean = total / rows
            covariance = (products / rows - np.outer(mean, mean)) / np.outer(self.scale, self.scale)
            sphere = max(np.trace(covariance) / d, 1e-3) * np.eye(d)
            factor = np.linalg.cholesky((1 - shrinkage) * covariance + shrinkage * sphere)
            self.classes[label] = ((mean - self.mean) / self.scale, factor, float(np.log(rows / n)))

    def log_density(self, z: np.ndarray, label: int) -> np.ndarray:
        mean, factor, prior = self.classes[label]
        solved = np.linalg.solve(factor, (z - mean).T)
        return prior - np.log(np.diag(factor)).sum() - 0.5 * (solved ** 2).sum(axis=0)

    def score(self, vectors: np.ndarray) -> np.ndarray:
        """Probability of label 1; with rows of one class only that class, with none one half."""
        if len(self.classes) < 2:
            return np.full(len(vectors), {(): 0.5, (0,): 0.0, (1,): 1.0}[tuple(self.classes)])
        z = np.clip((vectors - self.mean) / self.scale, -CLIP, CLIP)
        gap = self.log_density(z, 1) - self.log_density(z, 0)
        return 1 / (1 + np.exp(-np.clip(gap, -700, 700)))


def _partial_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        labels = batch.column("label").to_numpy(zero_copy_only=False)
        vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(labels), -1)
        for label in np.unique(labels):
            own = vectors[labels == label]
            have = sums.setdefault(int(label), [0.0, 0.0, 0.0])
            for i, value in enumerate((float(len(own)), own.sum(axis=0), own.T @ own)):
                have[i] = have[i] + value
    rows = [(label, i, float(v)) for label, (n, total, products) in sums.items()
            for i, v in enumerate([n, *total, *products.ravel()])]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
         pa.array([r[2] for r in rows], pa.float64())], ["label", "place", "value"])


def fit(vectors: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant:
    """Fit on all rows of ``labels`` (doc_id, label 0 or 1); other labels are ignored.

    Moments are summed in the tasks and then over them; what reaches the driver is one
    number for each class and pair of features.  An id that repeats counts each time.
    """
    d = len(FEATURES)
    sums = (vectors.join(labels.filter("label in (0, 1)").withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"))
            .select(F.col("label").cast("int"), "vector")
            .mapInArrow(_partial_moments, "label int, place int, value double")
            .groupBy("label", "place").agg(F.sum("value").alias("value")))
    by_label: dict[int, np.ndarray] = {}
    for label, place, value in sums.collect():  # 2 * (1 + d + d * d) rows
        by_label.setdefault(label, np.zeros(1 + d + d * d))[place] = value
    return Discriminant({k: (v[0], v[1:1 + d], v[1 + d:].reshape(d, d)) for k, v in sorted(by_label.items())}, shrinkage)


def _score(model, threshold: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            scores = model.value.score(batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)) if n else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"])
    return score


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0,
                   threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs`` (doc_id, text).

    ``labels`` has doc_id and label.  Ids whose crc32 modulo ``folds`` is ``held_out`` are
    never learned from.  A NULL or empty text has the smoothed usual vector and is scored
    like any other; a NULL id matches no label; rows that repeat an id are scored each.
    Without usable labels every score is one half.
    """
    vectors = cut_lineage(document_vectors(docs))
    model = fit(vectors, labels.select("doc_id", "label").filter(remainder("doc_id", folds) != held_out))
    scored = vectors.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), threshold),
                                "doc_id long, score double, predicted int")
    return scored.select("doc_id", (remainder("doc_id", folds) == held_out).alias("held_out"), "score", "predicted")


def _accept(model, threshold: float):
    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_runs(batches):
            scores = model.value.score(np.array([statistics(t) for t in texts]))
            yield batch.filter(pa.array(scores >= threshold))
    return accept


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` scored at ``threshold`` or more, with the columns of ``docs``.

    Two passes over the texts, one for the vectors to fit on and one that scores and filters;
    only vectors are joined, so no text is shuffled.
    """
    vectors = cut_lineage(document_vectors(docs))
    model = fit(vectors, labels.select("doc_id", "label").filter(remainder("doc_id", 5) != 0))
    return docs.mapInArrow(_accept(docs.sparkSession.sparkContext.broadcast(model), threshold), docs.schema)
