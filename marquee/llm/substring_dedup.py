"""Substring dedup by difference-cover anchors.

A word is removed if a window of ``WINDOW`` words around it also starts
anywhere else in the corpus. Windows are hashed only from anchor positions:
those whose number modulo ``PERIOD`` lies in the difference cover. For any two
equal windows some anchor has the same offset in both, so equal windows always
share an anchor (of ``ANCHOR`` words). Anchors that occur twice are extended:
all windows around them are hashed in full (96 bits) and compared. Less than a
quarter of the positions is shuffled in the first round, and only windows near
a repeated anchor in the second.

Scale: equal texts are one row from the start (combined before the shuffle),
so thousands of copies cost one. Within a slice of a few megabytes equal
hashes are settled at once and only one row per hash leaves it, so a passage
in a third of all documents makes one row per slice, not per document. Texts
are shuffled once; both rounds and the removal read that shuffle. Nothing is
broadcast or collected.

Texts are told apart by a 64-bit hash; a second hash is checked for each group
and the job stops with an error in the (unlikely) case of a collision. Then
another ``seed`` helps.

Defined results: a null text counts as empty and has no words; repeated rows
(same id and text) are copies of each other; texts under ``WINDOW`` words stay
as they are; null ids are kept; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.frames import Words, map_slices, mix, rolling

# --- fixed values ------------------------------------------------------------
WINDOW = 35
PERIOD = 21
COVER = (0, 1, 4, 14, 16)  # differences of its members give every residue
ANCHOR = WINDOW - PERIOD + 1
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
# -----------------------------------------------------------------------------


def texts_of(docs: DataFrame, text_col: str, seed: int = 0) -> DataFrame:
    """Distinct texts: k (hash), text, copies."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(key_of(text_col, seed), F.xxhash64(F.lit(seed + 1), text).alias("s"), text.alias("text"))
    grouped = rows.groupBy("k").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"),
                                    F.min("s").alias("s0"), F.max("s").alias("s1"))
    checked = F.when(F.col("s0") == F.col("s1"), F.col("text")).otherwise(
        F.raise_error(F.lit("two texts share a 64-bit hash; choose another seed")))
    return grouped.select("k", checked.alias("text"), "copies")


def key_of(text_col: str, seed: int = 0) -> F.Column:
    return F.xxhash64(F.lit(seed), F.coalesce(F.col(text_col), F.lit(""))).alias("k")


def one_per_slice(hashes: np.ndarray, more: np.ndarray, owner: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Rows (g, g2, f, k, at) of a slice. Equal hashes settle each other: all
    are marked (f), the first keeps the hash for the shuffle, the others get
    a key of their own that spreads them."""
    order = np.lexsort([more, hashes])
    hashes, more, owner, at = hashes[order], more[order], owner[order], at[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (more[1:] != more[:-1])
    group = np.cumsum(fresh) - 1
    sure = np.bincount(group, minlength=1)[group] > 1 if len(group) else fresh
    # Back in the order of the texts: neighbours in a shuffle block then share
    # their text's key, which compresses.
    back = np.lexsort([at, owner])
    spread = -(mix(owner.view(np.uint64) ^ mix(at.astype(np.uint64))) >> np.uint64(1)).astype(np.int64) - 1
    return pa.RecordBatch.from_pydict({
        "g": pa.array(np.where(fresh, hashes, spread)[back]), "g2": pa.array(more[back].astype(np.int32)),
        "f": pa.array(sure[back]), "k": pa.array(owner[back]), "at": pa.array(at[back].astype(np.int32))})


ROWS = "g long, g2 int, f boolean, k long, at int"


def positions(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: its text, its number in the text, the text's size."""
    owner = words.owners()
    return owner, np.arange(len(words.codes)) - words.starts[owner], words.counts[owner]


def anchors(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    size = window - PERIOD + 1
    in_cover = np.isin(np.arange(PERIOD), COVER)

    def find(part: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(part.column("text"))
        owner, at, total = positions(words)
        chosen = np.flatnonzero(in_cover[at % PERIOD] & (at + size <= total) & (total >= window))
        # 48 bits are enough here: what collides is looked at in full later.
        hashed = (rolling(words.hashes(), size, BASES[0])[chosen] >> np.uint64(16)).astype(np.int64)
        keys = part.column("k").to_numpy(zero_copy_only=False)
        return one_per_slice(hashed, np.zeros(len(chosen), np.int64), keys[owner[chosen]], at[chosen])

    return map_slices(texts.select("k", "text", "copies"), find, ROWS)


def extended(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """All windows around the repeated anchors ``at`` of each text."""

    def find(part: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(part.column("text"))
        lists = part.column("at")
        per = np.diff(lists.offsets.to_numpy())
        spots = lists.flatten().to_numpy().astype(np.int64)
        whose = np.repeat(np.arange(part.num_rows), per)
        # Mark the windows that hold an anchor whole, by a difference array.
        last = words.counts[whose] - window
        low = np.maximum(spots - (PERIOD - 1), 0)
        high = np.minimum(spots, last)
        ok = high >= low
        edge = np.zeros(len(words.codes) + 1, np.int64)
        np.add.at(edge, words.starts[whose[ok]] + low[ok], 1)
        np.add.at(edge, words.starts[whose[ok]] + high[ok] + 1, -1)
        chosen = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        hashes = words.hashes()
        first = rolling(hashes, window, BASES[0])[chosen].view(np.int64) & np.int64((1 << 63) - 1)
        second = (rolling(mix(hashes), window, BASES[1])[chosen] >> np.uint64(33)).astype(np.int64)
        owner = np.searchsorted(words.starts, chosen, side="right") - 1
        keys = part.column("k").to_numpy(zero_copy_only=False)
        return one_per_slice(first, second, keys[owner], chosen - words.starts[owner])

    return map_slices(texts.select("k", "text", "copies", "at"), find, ROWS)


def repeated(rows: DataFrame) -> DataFrame:
    """Places (k, list of at) of the hashes seen twice. A hash has one row per
    slice at most."""
    seen = F.count(F.lit(1)).over(Window.partitionBy("g", "g2"))
    return (rows.withColumn("n", seen).filter("n > 1 OR f")
            .groupBy("k").agg(F.collect_list("at").alias("at")))


def without(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """k, n_words, n_removed and the kept words of each text; ``at`` has the
    repeated windows (null: none), copies > 1 makes all windows repeated."""

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        texts_ = part.column("text").cast(pa.large_binary()).to_pylist()
        spots, copies = part.column("at").to_pylist(), part.column("copies").to_pylist()
        counts, gone, kept = [], [], []
        for text, at, many in zip(texts_, spots, copies, strict=True):
            words = text.split()
            n = len(words)
            counts.append(n)
            if many > 1 and n >= window:
                gone.append(n)
                kept.append("")
                continue
            if at and many == 1:
                edge = np.zeros(n + 1, np.int64)
                at = np.array(at)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                stay = np.cumsum(edge[:-1]) == 0
                words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
            gone.append(n - len(words))
            kept.append(b" ".join(words).decode())
        return pa.RecordBatch.from_pydict({"k": part.column("k"), "n_words": pa.array(counts, pa.int64()),
                                           "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.string())})

    return map_slices(texts.select("k", "text", "at", "copies"), cut,
                      "k long, n_words long, n_removed long, kept string")


def dedup_texts(docs: DataFrame, text_col: str = "text", window: int = WINDOW, seed: int = 0) -> DataFrame:
    """Per distinct text: k (see ``key_of``), n_words, n_removed and kept. All
    three readers of the texts take the same columns, so that they share one
    shuffle of them."""
    texts = texts_of(docs, text_col, seed)
    near = texts.join(repeated(anchors(texts, window)), "k")
    return without(texts.join(repeated(extended(near, window)), "k", "left"), window)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_removed and the kept text."""
    found = dedup_texts(docs, text_col)
    return docs.select(F.col(id_col), key_of(text_col)).join(found, "k").drop("k")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns: the kept text is hashed before the join to documents."""
    found = dedup_texts(docs, text_col).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
    return docs.select(F.col(id_col), key_of(text_col)).join(found, "k").select(
        id_col, "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (
  SELECT doc_id, s, array_to_string(ws[s : s + 34], ' ') AS t
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS s FROM w WHERE len(ws) >= 35)),
rep AS (SELECT doc_id, s FROM win WHERE t IN (SELECT t FROM win GROUP BY t HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS x FROM rep),
lists AS (SELECT doc_id, list(x) AS xs FROM gone GROUP BY 1),
kept AS (
  SELECT w.doc_id, len(ws) AS n, coalesce(len(xs), 0) AS r,
         CASE WHEN xs IS NULL THEN ws ELSE kept_words END AS ks
  FROM w LEFT JOIN lists USING (doc_id) LEFT JOIN (
    SELECT doc_id, list(word ORDER BY x) AS kept_words
    FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS x FROM w)
    ANTI JOIN gone USING (doc_id, x) GROUP BY 1) USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(ks, ' '), '')) AS kept_sha256
FROM kept
"""
