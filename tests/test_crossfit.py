"""Out-of-fold candidates and features; held-out quality of ranked lists."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marquee.operators import als as als_ops
from marquee.operators import crossfit, quality
from marquee.operators.features import ranker_features_from_parts
from marquee.operators.top_products import top_products

HYBRID = "userId int, movieId int, rating float, genres string, tag string"


def tastes(seed, users=90, items=60, share=0.5):
    """Ratings with structure: each user likes one of three kinds of items;
    items of equal kind differ little, so popularity says nothing."""
    rng = random.Random(seed)
    rows = []
    for u in range(users):
        for m in range(items):
            liked = u % 3 == m % 3
            if rng.random() < (share if liked else share / 3):
                rows.append((u, m, float(rng.choice([4.5, 5.0]) if liked else rng.choice([0.5, 1.0, 1.5])), "G", "t"))
    return rows


def test_a_score_never_depends_on_its_own_rating(spark):
    """Ratings of one fold changed: scores and statistics of that fold stay."""
    rows = tastes(1, 30, 24)
    hybrid = spark.createDataFrame(rows, HYBRID)
    fold = crossfit.fold_of(3)
    changed = hybrid.withColumn("rating", F.when(fold == 1, F.lit(5.5).cast("float") - F.col("rating")).otherwise(F.col("rating")))
    assert 0 < hybrid.filter(fold == 1).count() < len(rows)
    old, new = ({(r[0], r[1]): r[2] for r in crossfit.out_of_fold_candidates(h, 3, 24, max_iter=3).filter("fold = 1")
                 .select("userId", "movieId", "ALS_score").collect()} for h in (hybrid, changed))
    both = set(old) & set(new)  # the cut to 24 a user sees the other folds' scores
    assert len(both) > 100 and all(abs(old[p] - new[p]) < 1e-6 for p in both)
    stats = [sorted(tuple(r) for r in crossfit.out_of_fold_stats(h, 3).filter("fold = 1").collect()) for h in (hybrid, changed)]
    assert stats[0] == stats[1]
    other = [sorted(tuple(r) for r in crossfit.out_of_fold_stats(h, 3).filter("fold = 0").collect()) for h in (hybrid, changed)]
    assert other[0] != other[1]


def test_out_of_fold_stats(spark):
    rows = tastes(2, 20, 12) + [(500, 300, 4.0, "G", "t")]  # an item with one rating
    hybrid = spark.createDataFrame(rows, HYBRID)
    folds = {(r["userId"], r["movieId"]): r["f"] for r in hybrid.select("userId", "movieId", crossfit.fold_of(3).alias("f")).collect()}
    got = {(r["movieId"], r["fold"]): (r["avg_rating"], r["rating_count"]) for r in crossfit.out_of_fold_stats(hybrid, 3).collect()}
    assert len(got) == 3 * len({r[1] for r in rows})
    for (m, f), (mean, n) in got.items():
        values = [r[2] for r in rows if r[1] == m and folds[r[0], r[1]] != f]
        assert n == len(values) and (mean is None if not values else math.isclose(mean, sum(values) / n))
    assert got[300, folds[500, 300]] == (None, 0)  # never its own label


def test_features_do_not_hold_the_label(spark):
    hybrid = spark.createDataFrame(tastes(3), HYBRID)
    candidates = crossfit.out_of_fold_candidates(hybrid, 3, 20, max_iter=5).cache()
    per_user = Counter(r["userId"] for r in candidates.collect())
    assert max(per_user.values()) <= 20
    rows = crossfit.crossfit_features(candidates, hybrid)
    rated = rows.filter("label > 0").cache()
    assert rated.count() > 100
    assert rated.filter("ALS_score = label OR avg_rating = label").count() < 0.02 * rated.count()
    # The same rows as without cross-fitting of the statistics.
    plain = ranker_features_from_parts(candidates, hybrid)
    keys = ["userId", "movieId", "ALS_score", "label"]
    assert sorted(map(tuple, rows.select(keys).collect())) == sorted(map(tuple, plain.select(keys).collect()))


def brute_quality(lists, truth, k):
    out = {}
    for user in {u for u, _, _ in truth}:
        mine = {m: g for u, m, g in truth if u == user}
        best = sorted(mine.values(), reverse=True)[:k]
        idcg = sum(g / math.log2(i + 2) for i, g in enumerate(best))
        ranked = [(rank, m) for u, rank, m in lists if u == user and rank <= k]
        hits = [(rank, mine[m]) for rank, m in ranked if m in mine]
        dcg = sum(g / math.log2(rank + 1) for rank, g in hits)
        out[user] = (dcg / idcg if idcg else 0.0, len(hits) / min(k, len(mine)), 1 / min(hits)[0] if hits else 0.0)
    return out


def test_user_quality(spark):
    rng = random.Random(4)
    truth = [(u, m, rng.choice([0.0, 0.5, 3.0, 5.0])) for u in range(30) for m in rng.sample(range(40), rng.randrange(1, 20))]
    lists = [(u, i + 1, m) for u in range(28) for i, m in enumerate(rng.sample(range(40), 14))]
    truth.append((99, 1, 0.0))
    frame = spark.createDataFrame(truth, "userId int, movieId int, gain double")
    got = quality.user_quality(spark.createDataFrame(lists, "userId int, rank int, movieId int"), frame, 10)
    want = brute_quality(lists, truth, 10)
    found = {r["userId"]: tuple(r)[1:] for r in got.collect()}
    assert found.keys() == want.keys()
    assert all(math.isclose(a, b, abs_tol=1e-12) for u in want for a, b in zip(found[u], want[u], strict=True))
    # One list for all users.
    same = [(i + 1, m) for i, m in enumerate(rng.sample(range(40), 10))]
    got = quality.user_quality(spark.createDataFrame(same, "rank int, movieId int"), frame, 10)
    want = brute_quality([(u, r, m) for u in [*range(30), 99] for r, m in same], truth, 10)
    assert all(math.isclose(r["ndcg"], want[r["userId"]][0], abs_tol=1e-12) for r in got.collect())
    assert quality.ranking_quality({"none": got.limit(0).selectExpr("1 AS rank", "1 AS movieId")}, frame).first()["ndcg"] == 0.0


def test_als_beats_popularity_where_tastes_differ(spark):
    hybrid = spark.createDataFrame(tastes(5, 150, 90, 0.6), HYBRID)
    train, truth = quality.train_and_held_out(hybrid)
    model = als_ops.fit_als(train, rank=5, max_iter=6)
    top = top_products(model.userFactors, model.itemFactors, 80)
    lists = {"als": quality.known_removed(top.rows, train), "popularity": quality.popularity_list(train)}
    found = {r["list"]: r for r in quality.ranking_quality(lists, truth).collect()}
    assert found["als"]["n_users"] == found["popularity"]["n_users"] > 100
    assert found["als"]["ndcg"] > found["popularity"]["ndcg"] + 0.1
    assert found["als"]["recall"] > found["popularity"]["recall"]
    known = lists["als"].join(train.select("userId", "movieId"), ["userId", "movieId"]).count()
    assert known == 0 and lists["als"].agg(F.max("rank")).first()[0] == 10


@pytest.mark.parametrize("folds", [2, 4])
def test_folds_keep_a_pair_together(spark, folds):
    hybrid = spark.createDataFrame(tastes(6, 20, 20) * 2, HYBRID)
    each = hybrid.select("userId", "movieId", crossfit.fold_of(folds).alias("f")).distinct()
    assert each.count() == hybrid.select("userId", "movieId").distinct().count()
    assert {r["f"] for r in each.select("f").distinct().collect()} == set(range(folds))
