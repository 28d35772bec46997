"""Cleaning operators: null handling, casts, dedup, split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
UNKNOWN_TAG = "unknown"
SPLIT_FRACTIONS = (0.8, 0.1, 0.1)  # train / validation / test
SPLIT_NAMES = ("train", "validation", "test")
SPLIT_SEED = 42
# ---------------------------------------------------------------------------


def clean_ratings(ratings: DataFrame) -> DataFrame:
    """Drop rows without a rating, drop the timestamp, type the ids/rating."""
    return (ratings.dropna(subset=["rating"]).drop("timestamp")
            .select(F.col("userId").try_cast("int").alias("userId"),
                    F.col("movieId").try_cast("int").alias("movieId"),
                    F.col("rating").try_cast("float").alias("rating")))


def clean_tags(tags: DataFrame, dealt: bool = False) -> DataFrame:
    """One row per (userId, movieId, tag); the timestamp is dropped.

    Projecting the key before the dedup makes the result deterministic (a
    subset dropDuplicates would keep an arbitrary timestamp). Rows are dealt by
    (userId, movieId), which serves the dedup and a join on that pair alike;
    ``dealt`` says that they already are.
    """
    rows = tags.select("userId", "movieId", "tag")
    return (rows if dealt else rows.repartition("userId", "movieId")).distinct()


def als_triples(hybrid: DataFrame) -> DataFrame:
    """(userId, movieId, rating) with any null dropped (ALS input)."""
    return hybrid.select("userId", "movieId", "rating").dropna()


def fill_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Per-column null fill; column types are kept."""
    return df.fillna(defaults)


def item_genres(hybrid: DataFrame) -> DataFrame:
    return hybrid.select("movieId", "genres").distinct()


def item_tags(hybrid: DataFrame) -> DataFrame:
    return hybrid.select("movieId", "tag").distinct()


def labels_from_ratings(hybrid: DataFrame) -> DataFrame:
    return hybrid.select("userId", "movieId", F.col("rating").alias("label"))


def split_bucket(*key_cols: str, seed: int = SPLIT_SEED) -> F.Column:
    """Stable bucket 0..9999 from an md5 of the key (same in any engine and
    under any partitioning, unlike ``randomSplit``)."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols])
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % 10000).cast("int")


def split_ratings(triples: DataFrame, fractions=SPLIT_FRACTIONS, names=SPLIT_NAMES,
                  seed: int = SPLIT_SEED) -> DataFrame:
    """Adds ``split``: all rows of one (user, item) land in the same split."""
    bucket = split_bucket("userId", "movieId", seed=seed)
    bounds, acc = [], 0.0
    for frac in fractions[:-1]:
        acc += frac
        bounds.append(int(round(acc * 10000)))
    expr = F.lit(names[-1])
    for bound, name in reversed(list(zip(bounds, names))):
        expr = F.when(bucket < bound, F.lit(name)).otherwise(expr)
    return triples.withColumn("split", expr)
