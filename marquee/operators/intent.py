"""Request intents: genres named in the text, title named, parsed intent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.scores import confidence
from marquee.functions.text import GENRE_VOCAB, extract_genres
from marquee.operators.titles import attach_titles


def parse_queries(queries: DataFrame, movies: DataFrame, vocab=GENRE_VOCAB) -> DataFrame:
    """(query_id, intent_type, movieId, movie_genres, genres, confidence).

    A named title wins (confidence 1.0); else vocabulary genres
    (min(1, 0.5 + 0.1 n)); else unknown (0.0). Null or empty text is unknown.
    """
    q = attach_titles(queries.select("query_id", "text"), movies, "text")
    found = extract_genres("text", vocab)
    valid = F.col("text").isNotNull() & (F.col("text") != "")
    itype = (F.when(~valid, F.lit("unknown"))
             .when(F.col("movieId").isNotNull(), F.lit("movie"))
             .when(F.size(found) > 0, F.lit("genre"))
             .otherwise(F.lit("unknown")))
    parsed = q.select("query_id", itype.alias("intent_type"), "movieId",
                      F.col("genres").alias("movie_genres"), found.alias("_found"))
    return parsed.select(
        "query_id", "intent_type",
        F.when(F.col("intent_type") == "movie", F.col("movieId")).alias("movieId"),
        F.when(F.col("intent_type") == "movie", F.col("movie_genres")).alias("movie_genres"),
        F.when(F.col("intent_type") == "genre", F.col("_found")).alias("genres"),
        confidence("intent_type", F.size("_found")).alias("confidence"),
    )
