"""Ranker features without the fan-out equal the fan-out form, as multisets."""

import pytest
from pyspark.sql import functions as F

from marquee.operators.features import ranker_features, ranker_features_from_parts
from marquee.operators.hybrid import build_ranking

COLS = ["userId", "movieId", "ALS_score", "avg_rating", "rating_count", "label"]


def _same_multiset(a, b):
    a, b = a.select(*COLS), b.select(*COLS)
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0
    assert b.exceptAll(a).count() == 0


@pytest.mark.parametrize("k", [1, 3, 20])
def test_parts_equal_fanout_handmade(spark, k):
    # Movie 10: 2 genre strings x 3 tags; user 1 rated it twice (2 label rows).
    # Movie 20: one genre string, 1 tag. Movie 30: not in hybrid at all.
    hybrid = spark.createDataFrame([
        (1, 10, 4.0, "A", "x"), (1, 10, 4.0, "A|B", "y"), (2, 10, 2.0, "A", "z"),
        (1, 10, 3.0, "A", "x"), (2, 20, 5.0, "C", "unknown"), (3, 20, None, "C", "unknown"),
        (3, 40, 1.0, None, "unknown"),
    ], "userId int, movieId int, rating float, genres string, tag string")
    cands = spark.createDataFrame([
        (1, 10, 0.9), (1, 20, 0.9), (1, 30, 0.5), (1, 40, 0.95),
        (2, 10, 0.1), (2, 20, 0.7), (2, 30, 0.7),
        (3, 20, None), (3, 10, 0.2), (3, 10, 0.2),
    ], "userId int, movieId int, ALS_score double")
    fan = ranker_features(build_ranking(cands, hybrid), k)
    _same_multiset(ranker_features_from_parts(cands, hybrid, k), fan)


def test_parts_equal_fanout_driver_tables(small):
    fan = ranker_features(small.ranking)
    _same_multiset(ranker_features_from_parts(small.als_candidates, small.hybrid), fan)
    assert ranker_features_from_parts(small.als_candidates, small.hybrid) \
        .groupBy("userId").count().agg(F.max("count")).first()[0] <= 20


def test_parts_equal_fanout_hot_item(spark):
    # One item holds a third of all candidate rows and has many tags, so its
    # fan-out dominates; the multiplicity form must still give the same rows.
    users = range(1, 61)
    hybrid_rows = [(u, 7, float(1 + u % 5), "A|B", f"t{u % 9}") for u in users if u % 2 == 0]
    hybrid_rows += [(u, 100 + u, 3.0, "C", "unknown") for u in users]
    hybrid = spark.createDataFrame(hybrid_rows, "userId int, movieId int, rating float, genres string, tag string")
    cand_rows = [(u, 7, 0.5 + (u % 3) / 10) for u in users]
    cand_rows += [(u, 100 + ((u + j) % 60) + 1, 0.1 * j) for u in users for j in range(1, 3)]
    cands = spark.createDataFrame(cand_rows, "userId int, movieId int, ALS_score double")
    for k in (1, 5, 20):
        fan = ranker_features(build_ranking(cands, hybrid), k)
        _same_multiset(ranker_features_from_parts(cands, hybrid, k), fan)
