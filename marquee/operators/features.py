"""Ranker feature rows: fill nulls, keep the top k rows per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.operators.hybrid import movie_stats

FEATURE_COLUMNS = ("ALS_score", "avg_rating", "rating_count")
TOP_ROWS_PER_USER = 20


def ranker_features(ranking: DataFrame, k: int = TOP_ROWS_PER_USER) -> DataFrame:
    """(userId, movieId, ALS_score, avg_rating, rating_count, label), ≤ k per user.

    Order: ALS_score desc, then movieId, then label desc, so the kept multiset
    is fixed even with fan-out duplicates. ``row_number() <= k`` plans as a
    WindowGroupLimit: each map task keeps its own top k per user before the
    shuffle, so a user holding a third of all rows ships only k rows per task.
    """
    feats = ranking.select("userId", "movieId", *FEATURE_COLUMNS, "label").fillna(
        {"ALS_score": 0, "avg_rating": 0, "rating_count": 0, "label": 0})
    w = Window.partitionBy("userId").orderBy(
        F.col("ALS_score").desc(), F.col("movieId").asc(), F.col("label").desc())
    return (feats.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= k).drop("_rn"))


def ranker_features_from_parts(als_candidates: DataFrame, hybrid: DataFrame,
                               k: int = TOP_ROWS_PER_USER) -> DataFrame:
    """The rows of ``ranker_features(build_ranking(als_candidates, hybrid), k)``
    without building the ranking fan-out.

    In the ranking table a candidate (u, m) with label l appears
    n(u, m, l) x G(m) x T(m) times: n hybrid rows of (u, m) rated l (1 row of
    label 0 when there is none), G distinct genre strings and T distinct
    tags of m (1 for an item without hybrid rows). Those copies differ only
    in genres and tag, which the feature rows drop, so they are equal rows.
    Each (u, m, l) group is therefore kept once with its multiplicity; per
    user the first k groups in the feature order (every group has at least
    one row, so later groups can never reach the top k) get a running sum of
    multiplicities, and a group expands to min(multiplicity, k - rows before
    it) rows. The fan-out, which grows with tags per item, is never formed;
    work stays linear in the candidate table. As each candidate makes a group, only
    a user's first k candidates can be among them: the others are left out before
    they meet the labels and the counts of their items. Hybrid rows are dealt by (userId,
    movieId) once, for the counts and the join with the candidates.
    """
    labels = hybrid.select("userId", "movieId", "rating").repartition("userId", "movieId").groupBy(
        "userId", "movieId", "rating").agg(F.count(F.lit(1)).alias("_n"))
    genre_counts = hybrid.select("movieId", "genres").distinct().groupBy("movieId").agg(
        F.count(F.lit(1)).alias("_g"))
    tag_counts = hybrid.select("movieId", "tag").distinct().groupBy("movieId").agg(
        F.count(F.lit(1)).alias("_t"))
    stats = movie_stats(hybrid)
    w_row = Window.partitionBy("userId").orderBy(F.col("ALS_score").desc(), F.col("movieId").asc())
    cands = (als_candidates.select("userId", "movieId", "ALS_score").fillna({"ALS_score": 0})
             .withColumn("_rn", F.row_number().over(w_row)).filter(F.col("_rn") <= k).drop("_rn"))
    groups = (cands.join(labels, on=["userId", "movieId"], how="left")
              .join(stats, on="movieId", how="left")
              .join(genre_counts, on="movieId", how="left")
              .join(tag_counts, on="movieId", how="left"))
    mult = (F.coalesce(F.col("_n"), F.lit(1)) * F.coalesce(F.col("_g"), F.lit(1))
            * F.coalesce(F.col("_t"), F.lit(1)))
    feats = groups.select("userId", "movieId", "ALS_score", "avg_rating", "rating_count",
                          F.col("rating").alias("label"), mult.alias("_mult")).fillna(
        {"ALS_score": 0, "avg_rating": 0, "rating_count": 0, "label": 0})
    w = Window.partitionBy("userId").orderBy(
        F.col("ALS_score").desc(), F.col("movieId").asc(), F.col("label").desc())
    first = feats.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    before = F.coalesce(F.sum("_mult").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = first.withColumn("_before", before).filter(F.col("_before") < k).withColumn(
        "_take", F.least(F.col("_mult"), F.lit(k) - F.col("_before")))
    return taken.select("userId", "movieId", *FEATURE_COLUMNS, "label",
                        F.explode(F.sequence(F.lit(1), F.col("_take").cast("int"))).alias("_copy")).drop("_copy")


def group_sizes(features: DataFrame) -> DataFrame:
    """Rows per user (the pairwise learner's query groups)."""
    return features.groupBy("userId").agg(F.count(F.lit(1)).alias("group_size"))


def rows_by_user(features: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """All rows of a user in one partition, sorted by user inside it."""
    parts = features.repartition(num_partitions, "userId") if num_partitions else features.repartition("userId")
    return parts.sortWithinPartitions("userId", F.col("ALS_score").desc(), "movieId")
