"""Quality classifier: regularised quadratic discriminant analysis.

Each class is a Gaussian over transformed document statistics. A class
covariance is shrunk towards the pooled one and towards its own diagonal; its
Cholesky factor is kept, so a score is two triangular solves: the difference
of the Mahalanobis log-densities plus the log prior odds, as a probability.

The two Gaussians are fitted on a bounded sample (``SAMPLE_ROWS`` labelled
documents whose ids hash lowest, held-out ids excepted). Scoring is one scan:
a document's statistics are computed and scored in the task that reads it.

Defined results: a null or empty text has statistics of zero and gets a
score; repeated rows give repeated results; null ids are kept; an empty table
gives an empty result; with one class or none among the labels every score is
that class's share (0.5 without labels); extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.frames import Words, is_held_out, map_slices, training_rows

SAMPLE_ROWS = 30_000
CLASS_SHRINKAGE = 0.1  # towards the pooled covariance
DIAGONAL_SHRINKAGE = 0.05
THRESHOLD = 0.3
N_STATS = 10


def document_stats(texts: pa.Array) -> np.ndarray:
    """Transformed statistics of each text, one row per text."""
    words = Words(texts)
    n = words.counts.astype(float)
    values = words.values
    count = lambda x: np.asarray(x.to_numpy(zero_copy_only=False), float)
    chars = words.sums(count(pc.utf8_length(values)))
    upper = words.sums(count(pc.count_substring_regex(values, r"\p{Lu}")))
    letters = words.sums(count(pc.count_substring_regex(values, r"\p{L}")))
    digits = words.sums(count(pc.count_substring_regex(values, r"\p{N}")))
    symbols = words.sums(count(pc.count_substring_regex(values, r"[#*$%&|<>!=_]")))
    marks = words.sums(count(pc.count_substring_regex(values, r"[.,;:?]")))
    bare = words.sums(count(pc.invert(pc.match_substring_regex(values, r"[\p{L}\p{N}]"))))
    # The same word twice in a row, and distinct words.
    codes, owner = words.codes, words.owners()
    same = np.zeros(len(codes))
    if len(codes) > 1:
        same[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    run = np.concatenate([[0], np.cumsum(same)])
    runs = run[words.starts[1:]] - run[words.starts[:-1]]
    keys = np.unique(owner * np.int64(max(1, len(values))) + codes) // max(1, len(values))
    distinct = np.bincount(keys, minlength=len(texts)).astype(float)
    lines = 1 + count(pc.count_substring(texts, "\n"))
    per = lambda a, b: a / np.maximum(b, 1)
    share = lambda a, b: np.sqrt(np.clip(per(a, b), 0, 4))
    return np.column_stack([
        np.log1p(n), np.log1p(per(chars, n)), share(symbols, n), share(upper, letters),
        share(digits, chars), share(marks, n), share(bare, n), share(runs, n),
        # Vocabulary against what a text of this length usually has.
        np.log1p(distinct) - 0.85 * np.log1p(n), np.log1p(per(n, lines)),
    ])


class QuadraticDiscriminant:
    """Two shrunk Gaussians with cached Cholesky factors."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.parts = None
        if not len(labels) or not 0 < self.prior < 1:
            return
        self.mean, self.scale = rows.mean(axis=0), np.maximum(rows.std(axis=0), 1e-6)
        rows = (rows - self.mean) / self.scale
        groups = [rows[labels == k] for k in (0, 1)]
        scatter = [(g - g.mean(axis=0)).T @ (g - g.mean(axis=0)) for g in groups]
        pooled = sum(scatter) / len(rows)
        self.parts = []
        for g, s in zip(groups, scatter, strict=True):
            weight = max(CLASS_SHRINKAGE, 1 / len(g))
            cov = (1 - weight) * s / len(g) + weight * pooled
            cov = (1 - DIAGONAL_SHRINKAGE) * cov + DIAGONAL_SHRINKAGE * np.diag(np.diag(cov))
            factor = np.linalg.cholesky(cov + 1e-6 * np.eye(len(cov)))
            # The inverse of the triangular factor: a solve becomes a product.
            self.parts.append((g.mean(axis=0), np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(rows), self.prior)
        rows = (rows - self.mean) / self.scale
        density = [-0.5 * np.square((rows - centre) @ inverse.T).sum(axis=1) - log_det
                   for centre, inverse, log_det in self.parts]
        odds = density[1] - density[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> QuadraticDiscriminant:
    sample = training_rows(labels, label, sample_rows, id_col).select(
        F.col(id_col).alias("id_"), F.col("label").alias("label_"))
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_")).join(F.broadcast(sample), "id_")

    def measure(part: pa.RecordBatch) -> pa.RecordBatch:
        stats = pa.FixedSizeListArray.from_arrays(pa.array(document_stats(part.column("text_")).ravel()), N_STATS)
        return pa.RecordBatch.from_arrays([part.column("label_"), stats.cast(pa.list_(pa.float64()))], ["label", "x"])

    got = map_slices(rows.select("label_", "text_"), measure, "label int, x array<double>", "text_").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), N_STATS)
    y = got["label"].to_numpy(dtype=float)
    order = np.lexsort([y, *x.T])  # sums do not depend on the order of the rows
    return QuadraticDiscriminant(x[order], y[order])


def classify(docs: DataFrame, model: QuadraticDiscriminant, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """Per document: held_out, score and predicted."""

    def judge(part: pa.RecordBatch) -> pa.RecordBatch:
        score = model.score(document_stats(part.column("text_")))
        return pa.RecordBatch.from_pydict({
            "doc_id_": part.column("doc_id_"), "score": pa.array(score),
            "predicted": pa.array((score >= threshold).astype(np.int32))})

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_slices(docs.select(F.col(id_col).alias("doc_id_"), F.col(text_col).alias("text_")), judge,
                     f"doc_id_ {kind}, score double, predicted int", "text_")
    return out.select(F.col("doc_id_").alias(id_col), is_held_out(F.col("doc_id_")).alias("held_out"),
                      "score", "predicted")
