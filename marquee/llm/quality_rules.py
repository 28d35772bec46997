"""Quality rules with an isolation forest.

Rule statistics of each whole text; two hard rules; and an isolation forest
over the statistics, whose path lengths over random splits single out unusual
documents. The threshold comes from labelled rows.

Forest and threshold come from all labelled documents, whatever their number:
tasks measure them, Spark counts equal points of the forest's (coarse) space by
label, and the driver holds the counted points. Each of the 100 trees draws 256
documents from the whole (the method's own subsample); the threshold weighs every
labelled document. Each document is scored by itself inside its scan task.

Defined results: a null or empty text has no words and fails the base rules;
repeated rows give repeated results; null ids are kept; an empty table gives
an empty result; without labelled rows the forest rejects nothing; extra
columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.frames import Words, map_slices, training_rows

# --- fixed values ------------------------------------------------------------
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
TREES = 100
TREE_ROWS = 256
# Rejecting a share of the labelled good rows costs so many times as much as
# keeping the same share of the bad ones.
GOOD_WEIGHT = 20.0
# -----------------------------------------------------------------------------

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
EXTRA = "n_punct long"


def repeated_words(words: Words) -> np.ndarray:
    """Per text: words inside a 3-word window that the text holds at least twice."""
    out = np.zeros(len(words.counts), np.int64)
    size = np.int64(max(1, len(words.values)))
    for k, (start, n) in enumerate(zip(words.starts[:-1], words.counts, strict=True)):
        if n < 4:
            continue
        c = words.codes[start:start + n]
        pair = c[:-1] * size + c[1:]
        if size >= 1 << 20:  # keep three codes within 63 bits
            pair = np.unique(pair, return_inverse=True)[1]
        window = pair[:-1] * size + c[2:]
        order = np.argsort(window, kind="stable")
        ordered = window[order]
        same = ordered[1:] == ordered[:-1]
        if not same.any():
            continue
        twice = np.zeros(len(window), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = np.zeros(n, bool)
        for shift in range(3):
            hit[shift:shift + len(twice)] |= twice
        out[k] = hit.sum()
    return out


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def rule_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """The rule statistics of a slice of texts."""
    words = Words(texts)
    lines = np.fromiter((repeated_lines(t) for t in texts.to_pylist()), np.int64, len(texts))
    symbols = sum(pc.count_substring(texts, s).to_numpy(zero_copy_only=False).astype(np.int64) for s in SYMBOLS)
    value_chars = pc.utf8_length(words.values).to_numpy(zero_copy_only=False).astype(np.int64)
    # Punctuation is counted on the distinct words, then summed.
    punct = pc.count_substring_regex(words.values, r"[^\p{L}\p{N}]").to_numpy(zero_copy_only=False).astype(np.int64)
    return {
        "n_words": words.counts.astype(np.int64), "word_chars": words.sums(value_chars),
        "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeated_words(words),
        "n_punct": words.sums(punct),
    }


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    n = stats["n_words"]
    return (n < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * n)


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """The space of the forest: rule statistics at the resolution of a rule, so
    that chance differences between ordinary texts are no distance. Symbols
    per word in hundredths, punctuation per character in steps of 0.02, mean
    word length in powers of two. Repeats are left to the hard rules: ordinary
    texts that quote a shared passage twice are rare, but not junk."""
    n = np.maximum(stats["n_words"], 1)
    chars = np.maximum(stats["word_chars"], 1)
    return np.column_stack([
        np.round(stats["n_symbols"] / n, 2), np.round(stats["n_punct"] / chars / 0.02),
        np.floor(np.log2(np.maximum(stats["word_chars"], 1) / n)),
    ]).astype(np.float64)


class IsolationForest:
    """Random axis-parallel splits on subsamples; a row that few splits set
    apart is unusual. Trees are stored as flat arrays, scoring walks all rows
    of a slice one level at a time."""

    def __init__(self, rows: np.ndarray, counts: np.ndarray | None = None, trees: int = TREES, size: int = TREE_ROWS, seed: int = 17):
        """``counts``: how many documents each row stands for (default: one)."""
        rng = np.random.default_rng(seed)
        ends = np.cumsum(np.ones(len(rows), np.int64) if counts is None else counts)
        self.size = int(min(size, ends[-1]))
        self.depth = int(np.ceil(np.log2(max(2, self.size))))
        drawn = (rng.choice(ends[-1], self.size, replace=False) for _ in range(trees))
        self.trees = [self._grow(rows[np.searchsorted(ends, d, side="right")], rng) for d in drawn]

    @staticmethod
    def unsuccessful(n) -> np.ndarray:
        """Mean path length of a failed search among n rows."""
        n = np.asarray(n, float)
        harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
        return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    def _grow(self, rows: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, cut, left, length = [], [], [], []
        todo = [(rows, 0, self._slot(feature, cut, left, length))]
        while todo:
            part, depth, at = todo.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth >= self.depth or len(part) <= 1 or not len(open_):
                length[at] = depth + float(self.unsuccessful(len(part)))
                continue
            f = int(rng.choice(open_))
            feature[at], cut[at] = f, rng.uniform(low[f], high[f])
            a = self._slot(feature, cut, left, length)
            b = self._slot(feature, cut, left, length)
            left[at] = a
            side = part[:, f] < cut[at]
            todo += [(part[side], depth + 1, a), (part[~side], depth + 1, b)] if side.any() and not side.all() else []
            if not side.any() or side.all():
                feature[at], length[at] = -1, depth + float(self.unsuccessful(len(part)))
        return np.array(feature), np.array(cut), np.array(left), np.array(length)

    @staticmethod
    def _slot(feature, cut, left, length) -> int:
        feature.append(-1)
        cut.append(0.0)
        left.append(0)
        length.append(0.0)
        return len(feature) - 1

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; about 0.5 for usual rows, near 1 for isolated ones."""
        if not len(rows):
            return np.zeros(0)
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, cut, left, length in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                below = rows[every, np.maximum(f, 0)] < cut[at]
                at = np.where(inner, left[at] + np.where(below, 0, 1), at)
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(float(self.unsuccessful(self.size)), 1e-9))


def threshold(scores: np.ndarray, good: np.ndarray, counts: np.ndarray | None = None) -> float:
    """The cheapest cut between labelled scores, half way between its
    neighbours; above all scores if no cut is worth it. ``counts``: documents
    per score (default: one)."""
    counts = np.ones(len(scores), np.int64) if counts is None else counts
    levels, at = np.unique(scores, return_inverse=True)
    cuts = np.append((levels[1:] + levels[:-1]) / 2, levels[-1])

    def beyond(part: np.ndarray) -> np.ndarray:
        held = np.bincount(at[part], counts[part], len(levels))
        return 1 - np.cumsum(held) / max(1, held.sum())

    cost = GOOD_WEIGHT * beyond(good) + 1 - beyond(~good)
    return float(cuts[len(cost) - 1 - np.argmin(cost[::-1])])


def fit_forest(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """Forest and threshold from all labelled documents (labels.quality).
    Documents that the base rules reject do not count."""
    known = training_rows(labels, "quality", None, id_col, held_out=False).withColumnRenamed(id_col, "doc_id")

    def measure(part: pa.RecordBatch) -> pa.RecordBatch:
        stats = rule_stats(part.column("text"))
        kept = ~base_failed(stats)
        space = features(stats)[kept]
        return pa.RecordBatch.from_pydict({
            "doc_id": part.column("doc_id").filter(pa.array(kept)), **{f"x{i}": pa.array(space[:, i]) for i in range(space.shape[1])}})

    axes = ["x0", "x1", "x2"]
    # The points meet the labels, not the texts: nothing long is shuffled.
    points = map_slices(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("doc_id").isNotNull()), measure,
                        f"doc_id {docs.schema[id_col].dataType.simpleString()}, x0 double, x1 double, x2 double")
    got = points.join(known, "doc_id").groupBy(*axes, "label").agg(F.count(F.lit(1)).alias("n")).toPandas()
    got = got.sort_values([*axes, "label"], kind="stable")
    space, good, n = got[axes].to_numpy(dtype=float), got["label"].to_numpy() == 1, got["n"].to_numpy(dtype=np.int64)
    if not good.any():
        return None, 1.0
    forest = IsolationForest(space, n)
    return forest, threshold(forest.score(space), good, n)


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep_columns: tuple[str, ...] = ()) -> DataFrame:
    """Per document: the statistics, base_failed, anomaly (the forest's score)
    and kept. ``keep_columns`` of the input are passed through."""
    forest, limit = fit_forest(docs, labels, id_col, text_col)

    def judge(part: pa.RecordBatch) -> pa.RecordBatch:
        stats = rule_stats(part.column("text_"))
        failed = base_failed(stats)
        score = forest.score(features(stats)) if forest else np.zeros(part.num_rows)
        out = {"doc_id_": part.column("doc_id_"), **{k: pa.array(stats[k]) for k in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}}
        out |= {"base_failed": pa.array(failed), "anomaly": pa.array(score), "kept": pa.array(~failed & ~(score > limit))}
        return pa.RecordBatch.from_pydict(out | {f"_{c}": part.column(f"_{c}") for c in keep_columns})

    kind = docs.schema[id_col].dataType.simpleString()
    more = "".join(f", `_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep_columns)
    picked = docs.select(F.col(id_col).alias("doc_id_"), F.col(text_col).alias("text_"),
                         *[F.col(c).alias(f"_{c}") for c in keep_columns])
    out = map_slices(picked, judge,
                     f"doc_id_ {kind}, {STATS}, base_failed boolean, anomaly double, kept boolean{more}", "text_")
    return out.withColumnRenamed("doc_id_", id_col)
