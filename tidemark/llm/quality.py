"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class is a Gaussian over transformed statistics of the text. Its covariance is shrunk
twice: towards the covariance of both classes together, and towards its own diagonal, so it
stays well conditioned when one class is small. The Cholesky factors are computed once and
go to the tasks with the means; a score is the logistic of the difference of the two log
densities, which are Mahalanobis distances by one triangular solve each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

FEATURES = (
    "log_words", "word_length", "distinct", "repeats", "top_word", "upper", "digits", "marks", "bars", "breaks",
    "lines_distinct", "long_words",
)
THRESHOLD = 0.7
POOLED_SHARE = 0.1
DIAGONAL_SHARE = 0.05
RIDGE = 1e-3
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True
# Characters that shouting, symbol noise and broken tables leave behind.
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "!*#&%$@~^"]] = True


def statistics(text: str | None) -> list[float] | None:
    """The transformed statistics of one whole text; None where it has no words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return None
    n = len(words)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    total = float(len(raw))
    letters = max(1, int(counts[_LETTER].sum()))
    tally: dict[bytes, int] = {}
    get = tally.get
    repeats, before = 0, b""
    for w in words:
        tally[w] = get(w, 0) + 1
        if w == before:
            repeats += 1
        before = w
    lines = raw.split(b"\n")
    logit = lambda x, k: float(np.log((x * k + 0.5) / (k - x * k + 0.5)))
    return [
        float(np.log1p(n)),
        float(np.log(total / n)),
        logit(len(tally) / n, n),
        logit(repeats / n, n),
        logit(max(tally.values()) / n, n),
        logit(counts[_UPPER].sum() / letters, letters),
        logit(counts[_DIGITS].sum() / total, total),
        logit(counts[_MARKS].sum() / total, total),
        logit(counts[124] / total, total),
        logit(counts[10] / total, total),
        logit(len(set(lines)) / len(lines), len(lines)),
        logit(sum(len(w) > 14 for w in tally) / len(tally), len(tally)),
    ]


def _forward(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What a lower triangular factor takes to ``b``: one row at a time from those above it."""
    z = np.empty_like(b, dtype=np.float64)
    for i in range(len(b)):
        z[i] = (b[i] - factor[i, :i] @ z[:i]) / factor[i, i]
    return z


@dataclass(frozen=True)
class Model:
    """Per class (0, 1): log prior, mean, Cholesky factor of the shrunk covariance, its log determinant."""

    prior: np.ndarray
    mean: np.ndarray
    factor: np.ndarray
    log_det: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of statistics."""
        density = []
        for c in (0, 1):
            z = _forward(self.factor[c], (x - self.mean[c]).T)
            density.append(self.prior[c] - 0.5 * (z * z).sum(axis=0) - 0.5 * self.log_det[c])
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -50, 50)))


def fit(n: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Model:
    """The model from each class's row count, sums and sums of products.

    A class without rows takes the other's moments with a wide spread; without any rows every
    text scores one half.
    """
    d = sums.shape[1]
    if n.sum() == 0:
        return Model(np.zeros(2), np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2))
    pooled_mean = sums.sum(axis=0) / n.sum()
    pooled = products.sum(axis=0) / n.sum() - np.outer(pooled_mean, pooled_mean)
    means, factors, dets = [], [], []
    for c in (0, 1):
        if n[c] > 0:
            mean = sums[c] / n[c]
            cov = products[c] / n[c] - np.outer(mean, mean)
        else:
            mean, cov = pooled_mean, 4.0 * pooled
        cov = (1 - POOLED_SHARE) * cov + POOLED_SHARE * pooled
        cov = (1 - DIAGONAL_SHARE) * cov + DIAGONAL_SHARE * np.diag(np.diag(cov))
        cov += (RIDGE + 1e-2 * np.trace(cov) / d) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        means.append(mean)
        factors.append(factor)
        dets.append(2.0 * np.log(np.diag(factor)).sum())
    prior = np.log((n + 1.0) / (n.sum() + 2.0))
    return Model(prior, np.stack(means), np.stack(factors), np.array(dets))


def _fold(key) -> F.Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4))


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): statistics per row, null for texts without words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>")


def train(measured: DataFrame, labels: DataFrame) -> Model:
    """Moments of all labelled rows outside the held-out fold, summed on the executors.

    Labels other than 0 and 1 and null ids teach nothing; a document labelled twice counts
    with both labels. The driver gets two rows.
    """
    d = len(FEATURES)
    taught = (
        labels.where("quality in (0, 1) and doc_id is not null")
        .where(_fold(F.col("doc_id")) != 2)
        .select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("y"))
    )
    rows = measured.where("x is not null").join(taught, F.col("doc_id") == F.col("label_id"))
    cell = lambda i: F.element_at("x", i + 1)
    sums = [F.sum(cell(i)).alias(f"s{i}") for i in range(d)]
    products = [F.sum(cell(i) * cell(j)).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    n, s, p = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in rows.groupBy("y").agg(F.count("*").alias("n"), *sums, *products).collect():
        n[r["y"]] = r["n"]
        s[r["y"]] = [r[f"s{i}"] for i in range(d)]
        for i in range(d):
            for j in range(i, d):
                p[r["y"], i, j] = p[r["y"], j, i] = r[f"p{i}_{j}"]
    return fit(n, s, p)


def _scores(model: Model, x: list[list[float] | None]) -> np.ndarray:
    """A text without words scores 0: there is nothing in it to keep."""
    out = np.zeros(len(x))
    full = [i for i, v in enumerate(x) if v is not None]
    if full:
        out[full] = model.score(np.array([x[i] for i in full]))
    return out


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The op3 digest per document row: doc_id, held_out, score, predicted.

    The texts are read once: their statistics are a table in the shared folder, from which
    both training and scoring read. A null doc_id is not held out. Repeated rows are scored alike.
    """
    measured, _ = materialize(with_statistics(docs), "statistics")
    model = train(measured, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            scores = _scores(model, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return measured.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id",
        F.coalesce(_fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns as they were.

    A second pass over the texts scores and filters in place, so no text is shuffled. Null and
    empty texts are scored as texts without words, very long ones whole; repeated rows and rows
    without an id stand or fall alike, and an empty table gives an empty result. Without labels
    all scores are the same.
    """
    model = train(with_statistics(docs), labels)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            scores = _scores(model, [statistics(t) for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)
