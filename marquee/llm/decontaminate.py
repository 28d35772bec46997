"""Benchmark decontamination as a prefix-filtered set join, all in DataFrame
operations.

A benchmark item gives windows of ``WINDOW`` words (one shorter window if it
has fewer words). For exact containment the necessary prefix of a window is
its single rarest word, so windows are joined to document positions on that
word only. Position and length bounds place the window in the document; the
slice of the document found there is compared word by word.

Scale: the documents' words are written once below the checkpoint folder and
read twice (word counts, candidate search). Word counts are made for words of
the benchmark only and combined before the shuffle. The benchmark side is
broadcast after its rows were counted (``BROADCAST_ROWS`` windows at most);
beyond that the joins shuffle. Hits are grouped by document, so a group is
never larger than its document. No pair of documents is ever formed.

Defined results: a null or empty text has no words; null or empty items have
no windows; equal windows of several items count for each of them; an item id
that occurs twice is one item, a null item id is not reported (its windows
still hit); repeated document rows and null document ids are kept as they
are; empty tables give an empty result or no hits; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.frames import written

# --- fixed values ------------------------------------------------------------
WINDOW = 10
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 500_000
# -----------------------------------------------------------------------------


def words_of(text) -> F.Column:
    """Words after lowering A-Z. ``lower`` does the same, and faster, unless
    the text has capital letters beyond ASCII."""
    beyond = text.rlike(r"[[\p{javaUpperCase}\p{javaTitleCase}]&&[^A-Z]]")
    lowered = F.when(beyond, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), BREAKS), "")


def windows_of(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """One row per item and window: item_id (string), window (its words)."""
    words = items.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("ws"))
    words = words.filter(F.size("ws") > 0).withColumn("w", F.least(F.lit(window), F.size("ws")))
    starts = F.sequence(F.lit(1), F.size("ws") - F.col("w") + 1)
    return (words.withColumn("s", F.explode(starts))
            .select("item_id", F.slice("ws", F.col("s"), F.col("w")).alias("window")))


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it was counted to be small enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def find_hits(words: DataFrame, windows: DataFrame) -> DataFrame:
    """Occurrences (row_, start, stop, window) of the windows in the word lists
    (row_, ws)."""
    distinct = windows.select("window").distinct()
    n = distinct.count()
    vocabulary = distinct.select(F.explode("window").alias("word")).distinct()
    seen = words.select(F.explode("ws").alias("word"))
    counts = seen.join(sized(vocabulary, n * WINDOW), "word", "left_semi").groupBy("word").count()
    # The rarest word of each window; a word that no document has is rarest.
    tokens = distinct.select("window", F.posexplode("window").alias("offset", "word"))
    rarest = (tokens.join(counts, "word", "left")
              .groupBy("window").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word", "offset")).alias("t"))
              .filter("t.n > 0").select("window", F.col("t.word").alias("word"), F.col("t.offset").alias("offset")))
    rarest = written(rarest, "windows")
    places = words.select("row_", "ws", F.posexplode("ws").alias("at", "word"))
    start = F.col("at") - F.col("offset")
    found = places.join(sized(rarest, n), "word").filter(
        (start >= 0) & (start + F.size("window") <= F.size("ws"))
        & (F.slice("ws", F.greatest(start, F.lit(0)) + 1, F.size("window")) == F.col("window")))
    return found.select("row_", start.alias("start"), (start + F.size("window")).alias("stop"), "window")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  keep_columns: tuple[str, ...] = ()) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items (sorted ids) and
    contaminated; ``keep_columns`` of the input are passed through."""
    words = written(docs.select(
        F.col(id_col).alias("id_"), *[F.col(c).alias(f"_{c}") for c in keep_columns],
        words_of(F.col(text_col)).alias("ws")).withColumn("row_", F.monotonically_increasing_id()), "words")
    windows = windows_of(items, item_id, item_text, window)
    hits = written(find_hits(words.select("row_", "ws"), windows), "hits")
    # Words under the union of the hit intervals of a document.
    spans = hits.select("row_", "start", "stop").distinct()
    before = Window.partitionBy("row_").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0))))
    covered = spans.select("row_", fresh.alias("fresh")).groupBy("row_").agg(F.sum("fresh").alias("n_hit"))
    of_items = (hits.select("row_", "window").distinct().join(windows.filter("item_id IS NOT NULL").distinct(), "window")
                .select("row_", "item_id").distinct().groupBy("row_")
                .agg(F.sort_array(F.collect_list("item_id")).alias("items")))
    found = covered.join(of_items, "row_", "left")
    kept = [F.col(f"_{c}") for c in keep_columns]
    rows = words.select("id_", "row_", F.size("ws").cast("long").alias("n_words"), *kept)
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(found, "row_", "left").select(
        F.col("id_").alias(id_col), *kept, "n_words", hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
        items_.alias("items"), (hit > 0).alias("contaminated"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        "contaminated")


# Words and windows as above, by nested lists; positions joined on the text of
# a window for each window size.
ORACLE = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS w, array_to_string(ws[s : s + least(10, len(ws)) - 1], ' ') AS t
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS s FROM iw WHERE len(ws) > 0)),
pos AS (
  SELECT doc_id, s, w, array_to_string(ws[s : s + w - 1], ' ') AS t
  FROM (SELECT doc_id, ws, w, unnest(range(1, len(ws) - w + 2)) AS s
        FROM dw, (SELECT DISTINCT w FROM win) WHERE len(ws) >= w)),
hit AS (SELECT p.doc_id, p.s, p.w, win.item_id FROM pos p JOIN win USING (w, t)),
cov AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + w)) AS x FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
        FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
