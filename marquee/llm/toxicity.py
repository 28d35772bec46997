"""Toxicity: a learned lexicon, misspellings included, judged in context.

Terms that mark toxic documents are learned from labelled rows. They form a
trie; the Levenshtein automaton of distance one is intersected with it and
the product is made deterministic, so every term and all its misspellings are
found in one walk over a token's characters (terms under ``FUZZY_LENGTH``
letters must match exactly). A hit is weighed by its context window: hits
inside or beside quotation marks or verbs of speech count as quoted, hits
close to each other as abuse. A regularised logistic model over a few such
sums gives the score.

Learning uses a bounded sample (``SAMPLE_ROWS`` labelled documents whose ids
hash lowest, held-out ids excepted) and at most ``MAX_TERMS`` terms; the
automaton travels with the task (its size follows from these bounds). Scoring
is one scan over whole texts, no shuffle.

Defined results: null and empty texts get the score of a text without hits;
repeated rows give repeated results; null ids are kept; an empty table gives
an empty result; with labels of one class or none every score is that class's
share (0 without labels); extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.frames import Words, is_held_out, map_slices, training_rows

SAMPLE_ROWS = 30_000
MAX_TERMS = 250
MIN_TOXIC_DOCS = 3
MIN_LOG_ODDS = 2.5
FUZZY_LENGTH = 5
MAX_TOKEN = 32  # longer tokens are no words of a lexicon
WINDOW = 8  # words on either side
# --- fixed values ------------------------------------------------------------
TRIM = " \t.,;:!?\"'()[]{}<>|*#$%&~`^+=-_/\\«»„“”‘’…"
QUOTES = "[\"«»„“”]"
SPEECH = ("said", "says", "wrote", "quoted", "quote", "called", "word", "term", "dit", "sagte", "dijo")
# -----------------------------------------------------------------------------


def tokens(values: pa.Array) -> pa.Array:
    """Distinct words in lower case without outer punctuation."""
    return pc.utf8_trim(pc.utf8_lower(values), TRIM)


class Automaton:
    """Lexicon trie x Levenshtein automaton (distance 1), deterministic.

    A state is a set of (trie node, edits so far); ``table[state, letter]`` is
    the next state, letter 0 stands for all letters outside the lexicon."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        letters = sorted({ord(c) for t in terms for c in t})
        self.alphabet = np.array(letters, np.int64)
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        long_below = [False]
        for k, term in enumerate(terms):
            node, fuzzy = 0, len(term) >= FUZZY_LENGTH
            long_below[0] |= fuzzy
            for c in term:
                letter = letters.index(ord(c)) + 1
                if letter not in children[node]:
                    children[node][letter] = len(children)
                    children.append({})
                    long_below.append(False)
                node = children[node][letter]
                long_below[node] |= fuzzy
            ends[node] = k

        def close(items) -> frozenset:
            """Adds skipped lexicon letters; an exact node makes its edited twin idle."""
            found = set(items)
            for node, e in list(found):
                if e == 0:
                    found |= {(c, 1) for c in children[node].values() if long_below[c]}
            return frozenset((n, e) for n, e in found if e == 0 or (n, 0) not in found)

        def step(state: frozenset, letter: int) -> frozenset:
            out = set()
            for node, e in state:
                if (c := children[node].get(letter)) is not None and (e == 0 or long_below[c]):
                    out.add((c, e))
                if e == 0 and long_below[node]:
                    out.add((node, 1))
                    out |= {(c, 1) for x, c in children[node].items() if x != letter and long_below[c]}
            return close(out)

        start = close({(0, 0)})
        number = {frozenset(): 0, start: 1}
        order, rows, at = [frozenset(), start], [], 0
        while at < len(order):
            state, row = order[at], [0] * (len(letters) + 1)
            if state:
                useful = {x for n, _ in state for x in children[n]}
                other = step(state, 0)
                for letter in range(len(letters) + 1):
                    to = step(state, letter) if letter in useful else other
                    if to not in number:
                        number[to] = len(order)
                        order.append(to)
                    row[letter] = number[to]
            rows.append(row)
            at += 1
        self.table = np.array(rows, np.int32)
        self.term = np.full(len(order), -1, np.int32)
        self.edits = np.zeros(len(order), np.int8)
        for k, state in enumerate(order):
            hits = sorted((e, ends[n]) for n, e in state if n in ends and (e == 0 or len(terms[ends[n]]) >= FUZZY_LENGTH))
            if hits:
                self.edits[k], self.term[k] = hits[0]

    def match(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Term number (-1: none) and edits of each word; all words advance
        together, one character a step."""
        lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begins = np.cumsum(lengths) - lengths
        where = np.searchsorted(self.alphabet, points)
        known = where < len(self.alphabet)
        known[known] = self.alphabet[where[known]] == points[known]
        letter = np.where(known, where + 1, 0)
        state = np.where((lengths > 0) & (lengths <= MAX_TOKEN), 1, 0).astype(np.int64)
        alive = np.flatnonzero(state)
        for k in range(MAX_TOKEN):
            alive = alive[(lengths[alive] > k) & (state[alive] > 0)]
            if not len(alive):
                break
            state[alive] = self.table[state[alive], letter[begins[alive] + k]]
        return self.term[state], self.edits[state]


@dataclass
class Model:
    automaton: Automaton | None
    weights: np.ndarray  # per term
    coef: np.ndarray | None
    mean: np.ndarray | None
    scale: np.ndarray | None
    share: float

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text: logs of the summed weights of exact, misspelled and
        quoted hits, their weight per 100 words, and the heaviest window."""
        words = Words(texts)
        n = np.maximum(words.counts, 1).astype(float)
        out = np.zeros((len(n), 5))
        if self.automaton is None or not len(words.codes):
            return out
        term, edits = self.automaton.match(tokens(words.values))
        hit = np.flatnonzero(term[words.codes] >= 0)
        if not len(hit):
            return out
        code, owner = words.codes[hit], np.searchsorted(words.starts, hit, side="right") - 1
        weight, fuzzy = self.weights[term[code]], edits[code] > 0
        quote = pc.match_substring_regex(words.values, QUOTES).to_numpy(zero_copy_only=False)
        speech = pc.is_in(tokens(words.values), pa.array(SPEECH, words.values.type)).to_numpy(zero_copy_only=False)
        marks = np.concatenate([[0], np.cumsum((quote | speech)[words.codes])])
        low = np.maximum(hit - WINDOW, words.starts[owner])
        high = np.minimum(hit + WINDOW + 1, words.starts[owner + 1])
        quoted = marks[high] > marks[low]
        total = np.concatenate([[0], np.cumsum(weight * ~quoted)])
        window = total[np.searchsorted(hit, high)] - total[np.searchsorted(hit, low)]
        of = lambda mask: np.bincount(owner, weight * mask, len(n))
        exact, near, said = of(~fuzzy & ~quoted), of(fuzzy & ~quoted), of(quoted)
        heaviest = np.zeros(len(n))
        np.maximum.at(heaviest, owner, window)
        return np.column_stack([np.log1p(exact), np.log1p(near), np.log1p(said),
                                np.minimum(100 * (exact + near) / n, 50), heaviest])

    def score(self, texts: pa.Array) -> np.ndarray:
        x = self.features(texts)
        if self.coef is None:
            return np.full(len(x), self.share)
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale]) @ self.coef
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learn_terms(rows: DataFrame, positives: int, negatives: int) -> list[tuple[str, float]]:
    """Terms by log odds of document counts in toxic and other rows
    (text_, label_); at most ``MAX_TERMS``."""

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(part.column("text_"))
        label = part.column("label_").to_numpy(zero_copy_only=False)
        names = tokens(words.values).dictionary_encode()
        size = max(1, len(names.dictionary))
        codes = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.codes] if len(words.codes) else words.codes
        seen = np.unique(words.owners() * np.int64(size) + codes)
        toxic = label[seen // size] > 0
        per = [np.bincount(seen[m] % size, minlength=len(names.dictionary)) for m in (toxic, ~toxic)]
        return pa.RecordBatch.from_pydict({"term": names.dictionary.cast(pa.string()),
                                           "toxic": pa.array(per[0]), "other": pa.array(per[1])})

    counts = map_slices(rows.select("text_", "label_"), count, "term string, toxic long, other long", "text_")
    odds = F.log((F.col("toxic") + 0.5) / (positives + 1.0)) - F.log((F.col("other") + 0.5) / (negatives + 1.0))
    found = (counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
             .filter((F.col("toxic") >= MIN_TOXIC_DOCS) & (F.length("term").between(3, MAX_TOKEN)))
             .withColumn("odds", odds).filter(F.col("odds") >= MIN_LOG_ODDS)
             .orderBy((F.col("odds") * F.col("toxic")).desc(), "term").limit(MAX_TERMS))
    return [(r["term"], float(r["odds"])) for r in found.collect()]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 25) -> np.ndarray:
    """Newton's method for ridge-penalised logistic regression."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * len(x) / 100 * np.diag([1e-3] + [1.0] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty @ w
        hess = (x * (p * (1 - p))[:, None]).T @ x + penalty
        move = np.linalg.solve(hess + 1e-9 * np.eye(len(w)), grad)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    sample = training_rows(labels, label, sample_rows, id_col).select(
        F.col(id_col).alias("id_"), F.col("label").alias("label_"))
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_")).join(F.broadcast(sample), "id_")
    counts = rows.groupBy("label_").count().toPandas()
    positives = int(counts.loc[counts["label_"] > 0, "count"].sum())
    negatives = int(counts["count"].sum()) - positives
    if not positives or not negatives:
        return Model(None, np.zeros(0), None, None, None, 1.0 if positives else 0.0)
    terms = learn_terms(rows, positives, negatives)
    model = Model(Automaton([t for t, _ in terms]) if terms else None, np.array([w for _, w in terms]),
                  None, None, None, positives / (positives + negatives))

    def measure(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [part.column("label_"), pa.array(list(model.features(part.column("text_"))), pa.list_(pa.float64()))],
            ["label", "x"])

    got = map_slices(rows.select("label_", "text_"), measure, "label int, x array<double>", "text_").toPandas()
    x, y = np.array(got["x"].tolist(), float), (got["label"].to_numpy() > 0).astype(float)
    order = np.lexsort([y, *x.T])
    x, y = x[order], y[order]
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    model.coef = logistic((x - model.mean) / model.scale, y)
    return model


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = 0.5) -> DataFrame:
    """Per document: held_out, score and predicted."""

    def judge(part: pa.RecordBatch) -> pa.RecordBatch:
        score = model.score(part.column("text_"))
        return pa.RecordBatch.from_pydict({"doc_id_": part.column("doc_id_"), "score": pa.array(score),
                                           "predicted": pa.array((score >= threshold).astype(np.int32))})

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_slices(docs.select(F.col(id_col).alias("doc_id_"), F.col(text_col).alias("text_")), judge,
                     f"doc_id_ {kind}, score double, predicted int", "text_")
    return out.select(F.col("doc_id_").alias(id_col), is_held_out(F.col("doc_id_")).alias("held_out"),
                      "score", "predicted")
