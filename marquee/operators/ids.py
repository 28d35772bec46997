"""Rows that cannot be used, set aside with a reason, and dense ids.

Cleaning turns what does not fit into nulls and drops it. Here every row goes
somewhere: it is accepted, or it is a row of the quarantine table with the
reason. Ids of any type or size get dense integers 0, 1, 2, ... in their own
order, as factor models need them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: reasons, in the order in which they are looked for --------
NO_USER = "the user id is missing or no integer"
NO_MOVIE = "the movie id is missing or no integer"
NO_RATING = "the rating is missing or no number"
OUT_OF_RANGE = "the rating lies outside 0.5 to 5"
LEAST_RATING, MOST_RATING = 0.5, 5.0
# -----------------------------------------------------------------------------


def rating_faults(user: str = "userId", movie: str = "movieId", rating: str = "rating") -> Column:
    """The first reason why a raw rating row cannot be used, else null."""
    value = F.col(rating).try_cast("double")
    return (F.when(F.col(user).try_cast("bigint").isNull(), NO_USER)
            .when(F.col(movie).try_cast("bigint").isNull(), NO_MOVIE)
            .when(value.isNull() | F.isnan(value), NO_RATING)
            .when(~value.between(LEAST_RATING, MOST_RATING), OUT_OF_RANGE))


def judged_ratings(ratings: DataFrame) -> DataFrame:
    """``ratings`` (columns of any type) with ``reason``: null for usable rows."""
    return ratings.withColumn("reason", rating_faults())


def accepted(judged: DataFrame) -> DataFrame:
    """(userId bigint, movieId bigint, rating float) of the usable rows."""
    return judged.filter(F.col("reason").isNull()).select(
        F.col("userId").try_cast("bigint").alias("userId"), F.col("movieId").try_cast("bigint").alias("movieId"),
        F.col("rating").try_cast("float").alias("rating"))


def quarantined(judged: DataFrame) -> DataFrame:
    """The other rows, as they came, with the reason."""
    return judged.filter(F.col("reason").isNotNull())


def row_balance(judged: DataFrame) -> DataFrame:
    """(reason, n_rows), the accepted rows under 'accepted': sums to all rows."""
    return judged.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


def dense_ids(rows: DataFrame, column: str, index: str = "index") -> DataFrame:
    """(column, index): a number from 0 on for every distinct value, in the
    order of the values.

    Distinct values are dealt into ranges and written; each range is numbered
    by itself and starts where the ranges before it end. The only thing that
    all tasks share is one count per range; no task sees all values.
    """
    from marquee.session import shared_dir

    spark = rows.sparkSession
    values = rows.select(column).filter(F.col(column).isNotNull()).distinct()
    path = shared_dir(spark, "id-ranges")
    values.repartitionByRange(column).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = ranged.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1)
    # One row per range of the shuffle: at most as many as it has partitions.
    return within.join(F.broadcast(before), "_part").select(column, (F.col("_before") + F.col("_rn")).alias(index))


def with_dense_ids(ratings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ratings with dense int ids, and the two tables that name them:
    (userId, index) and (movieId, index). More than 2**31 ids are an error of
    the cast, never a null."""
    users, movies = dense_ids(ratings, "userId"), dense_ids(ratings, "movieId")
    out = (ratings.join(users.withColumnRenamed("index", "_u"), "userId").join(movies.withColumnRenamed("index", "_m"), "movieId")
           .select(F.col("_u").cast("int").alias("userId"), F.col("_m").cast("int").alias("movieId"), "rating"))
    return out, users, movies
