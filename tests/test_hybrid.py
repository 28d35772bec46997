"""Fan-out parity (L1), unmatched movies and the weighted-sum rewrite."""

from pyspark.sql import functions as F

from marquee.operators.features import ranker_features
from marquee.operators.hybrid import build_hybrid, build_ranking, movie_stats, ranking_item_scores


def _golden(spark):
    ratings = spark.createDataFrame([(1, 10, 5.0, 0), (2, 10, 1.0, 0), (3, 20, 4.0, 0)],
                                    "userId int, movieId int, rating float, timestamp long")
    movies = spark.createDataFrame([(10, "Ten (2000)", "Drama")], "movieId int, title string, genres string")
    tags = spark.createDataFrame([(1, 10, "a", 0), (1, 10, "b", 0), (1, 10, "c", 0), (1, 10, "c", 5)],
                                 "userId int, movieId int, tag string, timestamp long")
    cands = spark.createDataFrame([(1, 10, 4.0), (2, 10, 2.0)], "userId int, movieId int, ALS_score double")
    return ratings, movies, tags, cands


def test_fanout_golden(spark):
    ratings, movies, tags, cands = _golden(spark)
    hybrid = build_hybrid(ratings, movies, tags).filter(F.col("movieId") == 10)
    stats = movie_stats(hybrid).collect()[0]
    assert (stats["avg_rating"], stats["rating_count"]) == (4.0, 4)
    dedup = movie_stats(hybrid, dedup=True).collect()[0]
    assert (dedup["avg_rating"], dedup["rating_count"]) == (3.0, 2)
    ranking = build_ranking(cands, hybrid)
    assert ranking.count() == 16
    assert ranking.agg(F.avg("ALS_score")).first()[0] == 3.5
    fast = ranking_item_scores(cands, hybrid).collect()[0]
    assert (fast["als"], fast["rating"], fast["count"]) == (3.5, 4.0, 4)


def test_unmatched_movie(spark):
    ratings, movies, tags, _ = _golden(spark)
    row = build_hybrid(ratings, movies, tags).filter(F.col("movieId") == 20).collect()
    assert len(row) == 1 and row[0]["genres"] is None and row[0]["tag"] == "unknown"


def test_weighted_sums_equal_fanout(small):
    """avg/avg/max over the fan-out table == weighted sums without it."""
    slow = small.ranking.groupBy("movieId").agg(
        F.round(F.avg("ALS_score"), 9).alias("als"), F.round(F.avg("avg_rating"), 9).alias("rating"),
        F.max("rating_count").alias("count"))
    fast = ranking_item_scores(small.als_candidates, small.hybrid).select(
        "movieId", F.round("als", 9).alias("als"), F.round("rating", 9).alias("rating"), "count")
    assert sorted(slow.collect()) == sorted(fast.collect())


def test_features_topk(small):
    f = ranker_features(small.ranking)
    per_user = f.groupBy("userId").count()
    assert per_user.agg(F.max("count")).first()[0] <= 20
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan or "AdaptiveSparkPlan" in plan


def test_repartition_invariance(small):
    base = sorted(small.hybrid.collect())
    for n in (1, 7):
        assert sorted(small.hybrid.repartition(n).collect()) == base
