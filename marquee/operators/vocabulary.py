"""Which words of a vocabulary table occur in which texts.

The request rule (a word counts wherever it is a substring of the lowered
text) for vocabularies of any size: words are found in the texts as titles are
(see ``titles``), so neither the words nor the texts are multiplied by each other
and only a filter of bounded size is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import GENRE_VOCAB
from marquee.operators.titles import title_pieces

WORD_GRAM = 4


def vocabulary_hits(texts: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str = "text",
                    word_col: str = "word", k: int = WORD_GRAM) -> DataFrame:
    """(id, word): every vocabulary word (lower-cased, distinct) that occurs in
    the lowered text. Null and empty words and texts have no hits; equal
    texts are searched once, however many rows have them."""
    words = vocabulary.select(F.lower(F.col(word_col)).alias("key")).filter(F.length("key") > 0).distinct()
    keys = words.withColumn("klen", F.length("key"))
    rows = texts.select(F.col(id_col), F.lower(F.col(text_col)).alias("qn")).filter(F.length("qn") > 0).withColumn(
        "tid", F.unhex(F.md5("qn")))
    distinct = rows.select("tid", "qn").dropDuplicates(["tid"])
    found = title_pieces(distinct, keys, k).join(words.hint("shuffle_hash"), "key").distinct()
    return rows.select(id_col, "tid").join(found, "tid").select(id_col, F.col("key").alias("word")).distinct()


def genres_from_vocabulary(texts: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, genres) for every text: its vocabulary words, sorted (the list form
    of ``extract_genres`` with the vocabulary as a table)."""
    hits = vocabulary_hits(texts, vocabulary, id_col, text_col).groupBy(id_col).agg(
        F.sort_array(F.collect_set("word")).alias("genres"))
    empty = F.array().cast("array<string>")
    return texts.select(id_col).join(hits, id_col, "left").select(id_col, F.coalesce("genres", empty).alias("genres"))


def default_vocabulary(spark) -> DataFrame:
    return spark.createDataFrame([(w,) for w in GENRE_VOCAB], "word string")
