"""Offline tables: the hybrid interaction table, item stats, ranking table.

Parity note: the hybrid table repeats a rating once per tag its user gave the
item, and every aggregate of the reference is computed over that repetition.
That is kept by default; ``dedup=True`` variants aggregate distinct ratings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators.clean import UNKNOWN_TAG, clean_ratings, clean_tags


def build_hybrid(ratings: DataFrame, movies: DataFrame, tags: DataFrame, dealt_tags: bool = False) -> DataFrame:
    """ratings ⟕ movies(movieId) ⟕ tags(userId, movieId); null tag → 'unknown'.

    The tag join shuffles both sides once on (userId, movieId), a key with no
    hot value (``clean_tags`` leaves its rows dealt by it; ``dealt_tags``: they
    come so), and runs first, so genres are not shuffled. movies is projected to (movieId, genres), so a
    small catalog is broadcast by size (AQE/auto threshold).
    """
    r = clean_ratings(ratings)
    m = movies.select("movieId", "genres")
    t = clean_tags(tags, dealt_tags)
    joined = r.join(t, on=["userId", "movieId"], how="left").join(m, on="movieId", how="left")
    return joined.fillna({"tag": UNKNOWN_TAG}).select("userId", "movieId", "rating", "genres", "tag")


def movie_stats(hybrid: DataFrame, dedup: bool = False) -> DataFrame:
    """avg/count of rating per movie (partial aggregation before the shuffle)."""
    src = hybrid.select("userId", "movieId", "rating")
    if dedup:
        src = src.distinct()
    return src.groupBy("movieId").agg(
        F.avg("rating").alias("avg_rating"),
        F.count("rating").alias("rating_count"),
    )


def build_ranking(als_candidates: DataFrame, hybrid: DataFrame) -> DataFrame:
    """Ranking table with the reference's fan-out.

    candidates ⟕ stats ⟕ item genres ⟕ item tags ⟕ labels; null label → 0.
    The (userId, movieId) label join runs first, before the per-item
    fan-out multiplies the rows; the per-item tables are keyed by movieId
    and are broadcast by AQE when their measured size allows.
    """
    stats = movie_stats(hybrid)
    genres = hybrid.select("movieId", "genres").distinct()
    tags = hybrid.select("movieId", "tag").distinct()
    labels = hybrid.select("userId", "movieId", F.col("rating").alias("label"))
    cands = als_candidates.select("userId", "movieId", "ALS_score")
    out = (cands.join(labels, on=["userId", "movieId"], how="left")
           .join(stats, on="movieId", how="left")
           .join(genres, on="movieId", how="left")
           .join(tags, on="movieId", how="left"))
    return out.fillna({"label": 0}).select(
        "userId", "movieId", "ALS_score", "avg_rating", "rating_count", "genres", "tag", "label")


def ranking_item_scores(als_candidates: DataFrame, hybrid: DataFrame) -> DataFrame:
    """Per movie: avg(ALS_score), avg(avg_rating), max(rating_count) over the
    ranking table's rows, without building the fan-out.

    An ALS row (u, m) is repeated genres(m) x tags(m) x max(1, labels(u, m))
    times. The first two factors are constant within a movie and cancel in an
    average, so avg = sum(w * ALS) / sum(w) with w = max(1, hybrid rows of
    (u, m)); avg_rating and rating_count are constant per movie.
    """
    label_rows = hybrid.groupBy("userId", "movieId").agg(F.count(F.lit(1)).alias("_n"))
    weighted = (als_candidates.select("userId", "movieId", F.col("ALS_score").cast("double").alias("s"))
                .join(label_rows, on=["userId", "movieId"], how="left")
                .withColumn("_w", F.greatest(F.coalesce(F.col("_n"), F.lit(0)), F.lit(1)).cast("double")))
    als = weighted.groupBy("movieId").agg(
        (F.sum(F.col("s") * F.col("_w")) / F.sum(F.when(F.col("s").isNotNull(), F.col("_w")))).alias("als"))
    stats = movie_stats(hybrid)
    return als.join(stats, on="movieId", how="left").select(
        "movieId", "als", F.col("avg_rating").alias("rating"), F.col("rating_count").alias("count"))
