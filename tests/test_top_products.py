"""Exact top k by inner product against the full product and MLlib."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators import als as als_ops
from marquee.operators.top_products import best_of, top_products

FACTORS = "id int, features array<float>"


def frames(spark, users, items):
    return (spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in users], FACTORS).repartition(3),
            spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in items], FACTORS).repartition(3))


def full_product(users, items, k):
    for u, v in users:
        scores = [(-float(np.float32(v) @ np.float32(w)), i) for i, w in items]
        yield u, [i for _, i in sorted(scores)[:k]], [-s for s, _ in sorted(scores)[:k]]


def check(found, users, items, k):
    got = {}
    for r in found.rows.orderBy("userId", "rank").collect():
        got.setdefault(r["userId"], []).append((r["movieId"], r["score"]))
    for u, movies, scores in full_product(users, items, k):
        assert np.allclose([s for _, s in got[u]], scores, atol=1e-5)
        by_item = {i: float(np.float32(dict(users)[u]) @ np.float32(w)) for i, w in items}
        assert len({m for m, _ in got[u]}) == len(movies)
        assert all(abs(by_item[m] - s) < 1e-5 for m, s in got[u])
    assert len(got) == len(users)


@pytest.mark.parametrize("spread", ["flat", "falling", "signed"])
def test_top_products_equal_the_full_product(spark, spread):
    rng = np.random.default_rng(3)
    users = [(i, rng.random(6)) for i in range(120)]
    items = [(1000 + i, rng.random(6)) for i in range(700)]
    if spread == "falling":
        items = [(i, v * 0.99 ** (i - 1000)) for i, v in items]
    if spread == "signed":
        items = [(i, v - 0.5) for i, v in items]
        users = [(i, v - 0.5) for i, v in users]
    found = top_products(*frames(spark, users, items), 10, item_tile=32, user_block=50)
    check(found, users, items, 10)
    share = found.visits.agg(F.sum("n_items")).first()[0] / (len(users) * len(items))
    assert share <= 1 and (spread != "falling" or share < 0.4)


def test_top_products_at_the_edges(spark):
    """Equal norms split over tiles, zero vectors, fewer items than k, nothing."""
    users = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 2.0])]
    items = [(i, [0.6, 0.8]) for i in range(90)] + [(100, [0.0, 0.0])]
    found = top_products(*frames(spark, users, items), 5, item_tile=8, user_block=2)
    check(found, users, items, 5)
    first = [r["movieId"] for r in found.rows.filter("userId = 1").orderBy("rank").collect()]
    assert first == [0, 1, 2, 3, 4]  # ties by id, whatever the tile
    few = items[:3]
    check(top_products(*frames(spark, users, few), 5, item_tile=2), users, few, 5)
    assert top_products(*frames(spark, users, []), 5).rows.count() == 0
    assert top_products(*frames(spark, [], items), 5).rows.count() == 0


def test_best_of_breaks_ties_by_id():
    scores = np.array([[1.0, 2.0, 2.0, 2.0, 0.0]], np.float32)
    assert best_of(scores, np.array([9, 8, 3, 5, 1]), 2)[:, 1].tolist() == [2, 3]


def test_candidates_equal_mllib(small):
    model = als_ops.fit_als(small.hybrid, max_iter=3)
    ours = als_ops.candidates(model, 50)
    theirs = model.recommendForAllUsers(50).select("userId", F.posexplode("recommendations").alias("rank", "r")).select(
        "userId", "rank", F.col("r.rating").alias("theirs"))
    from pyspark.sql import Window
    w = Window.partitionBy("userId").orderBy(F.col("ALS_score").desc())
    ranked = ours.withColumn("rank", F.row_number().over(w) - 1)
    both = ranked.join(theirs, ["userId", "rank"], "full").cache()
    assert both.count() == ours.count() == theirs.count()
    assert both.filter("ALS_score IS NULL OR theirs IS NULL OR abs(ALS_score - theirs) > 1e-4").count() == 0
    predicted = model.transform(ours.select("userId", "movieId", "ALS_score"))
    assert predicted.filter("abs(prediction - ALS_score) > 1e-4").count() == 0


def test_users_and_items_do_not_multiply_on_disk(spark):
    """Many tiles and blocks: lists come from one pass, nothing of a user is
    sent per tile, and block and pack sizes do not change a list."""
    from marquee.operators.top_products import blocks_of

    rng = np.random.default_rng(5)
    users = [(i, rng.random(4)) for i in range(90)]
    items = [(500 + i, rng.random(4)) for i in range(600)]
    lists = []
    for block in (7, 1000):
        found = top_products(*frames(spark, users, items), 10, item_tile=16, user_block=block)
        check(found, users, items, 10)
        assert "Exchange" not in found.rows._jdf.queryExecution().toString()
        lists.append([r["movieId"] for r in found.rows.orderBy("userId", "rank").collect()])
    assert lists[0] == lists[1]
    assert blocks_of(600_000, 12, 131_072) == 24 and blocks_of(3_600_000, 12, 131_072) == 28
