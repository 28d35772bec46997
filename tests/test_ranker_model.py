"""The ranker: gradients by brute force, layout independence, node tables,
save and load; ALS blocks; held-out quality."""

import math

import pytest
from pyspark.sql import functions as F

from marquee.operators import als as als_ops
from marquee.operators.features import ranker_features
from marquee.operators.pairwise import PairwiseRanker, Tree, score_rows, train_pairwise, with_pair_gradients

COLUMNS = ["ALS_score", "avg_rating", "rating_count"]


def test_gradients_are_the_pair_sums(spark):
    rows = [(1, 5.0, 0.3), (1, 3.0, 0.9), (1, 3.0, -0.2), (1, 1.0, 2.0), (2, 4.0, 0.0), (3, 1.0, 0.1), (3, 2.0, 0.1)]
    df = spark.createDataFrame(rows, "userId int, label double, score double")
    got = {(r["userId"], r["label"], r["score"]): (r["g"], r["h"]) for r in with_pair_gradients(df).collect()}
    for u, y, s in rows:
        g = h = 0.0
        for v, z, t in rows:
            if v == u and z != y:
                p = 1 / (1 + math.exp(s - t if y > z else t - s))
                g += -p if y > z else p
                h += p * (1 - p)
        assert got[(u, y, s)] == pytest.approx((g, h))


def test_scores_do_not_depend_on_the_layout(small):
    feats = ranker_features(small.ranking).select("userId", "movieId", *COLUMNS, "label").cache()
    seen = []
    for n in (1, 4, 7):
        model = train_pairwise(feats.repartition(n), n_trees=2)
        seen.append(sorted(tuple(r) for r in score_rows(feats, model).select("userId", "movieId", F.round("score", 9)).collect()))
    assert seen[0] == seen[1] == seen[2]
    feats.unpersist()


def hand_made(trees=100):
    tree = Tree([("split", 0, 2.5, 1, 2), ("leaf", -1.0), ("split", 1, 3.0, 3, 4), ("leaf", 0.5), ("leaf", 2.0)])
    return PairwiseRanker(COLUMNS, [(["ALS_score", "rating_count"], tree)] * trees, 0.1, [{"round": 1, "pair_loss": 0.5}])


def test_a_hundred_trees_score_by_their_nodes(spark):
    df = spark.createDataFrame([(2.5, 0.0, 9.0), (3.0, 0.0, 3.0), (3.0, 0.0, 4.0), (None, 0.0, 1.0), (3.0, 0.0, None)],
                               "ALS_score double, avg_rating double, rating_count double")
    got = [r["score"] for r in score_rows(df, hand_made()).collect()]
    assert got == pytest.approx([-10.0, 5.0, 20.0, 5.0, 20.0])
    assert score_rows(df.limit(0), hand_made()).count() == 0


def test_save_and_load(spark, tmp_path):
    model = hand_made(3)
    model.save(spark, f"{tmp_path}/model")
    assert PairwiseRanker.load(spark, f"{tmp_path}/model") == model


def test_als_blocks_are_fixed(small):
    """The same model whatever the layout of the input."""
    a = als_ops.candidates(als_ops.fit_als(small.hybrid.repartition(3), max_iter=2, num_blocks=5))
    b = als_ops.candidates(als_ops.fit_als(small.hybrid.repartition(7), max_iter=2, num_blocks=5))
    left = {(r[0], r[1]): r[2] for r in a.collect()}
    right = {(r[0], r[1]): r[2] for r in b.collect()}
    both = left.keys() & right.keys()
    assert len(both) >= 0.999 * len(left) and all(abs(left[k] - right[k]) < 1e-4 for k in both)


def test_a_group_that_is_too_large_is_an_error(spark):
    rows = spark.createDataFrame([(1, i, float(i), 1.0, 1, float(i % 2)) for i in range(150)],
                                 "userId int, movieId int, ALS_score double, avg_rating double, rating_count long, label double")
    with pytest.raises(ValueError, match="150 rows"):
        train_pairwise(rows, n_trees=1)


def test_packed_rounds_equal_rows(spark):
    """Gradients, metrics and sampling of packed groups are those of the rows;
    a round shuffles cells only."""
    import numpy as np
    from pyspark.sql import functions as F

    from marquee.operators.pairwise import pair_terms, row_bucket, with_pair_gradients
    rng = np.random.default_rng(2)
    rows = [(u, float(rng.integers(1, 4)), float(np.round(rng.normal(), 1)), int(rng.integers(-2**62, 2**62))) for u in range(60) for _ in range(u % 9)]
    df = spark.createDataFrame(rows, "userId int, label double, score double, rid long")
    got = with_pair_gradients(df, metrics=True).select("*", (F.abs(F.xxhash64("rid", F.lit(47))) % 10000).alias("bucket")).toPandas()
    want = got.sort_values("userId", kind="stable")
    sizes = want.groupby("userId").size().to_numpy()
    terms = pair_terms(sizes, want["label"].to_numpy(), want["score"].to_numpy(), True)
    for c in ("g", "h", "_pn", "_pok", "_ploss"):
        assert np.allclose(terms[c], want[c].to_numpy(dtype=float), atol=1e-12), c
    assert (row_bucket(want["rid"].to_numpy(), 47) == want["bucket"].to_numpy()).all()
