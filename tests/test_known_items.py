"""Lists without the items that a user knows are cut after those are left out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators import quality
from marquee.operators.top_products import top_products
from marquee.plans import models

HYBRID = "userId int, movieId int, rating float, genres string, tag string"
FACTORS = "id int, features array<float>"


@pytest.mark.parametrize(("tile", "block", "merge"), [(16, 7, 50), (1024, 1000, 10**6)])
def test_known_items_leave_lists_whole(spark, monkeypatch, tile, block, merge):
    """A user who knows the best 40 items, one who knows all but three, pairs that come
    twice, unknown and null ids: every list is the exact best of what is left."""
    from marquee.operators import top_products as module
    monkeypatch.setattr(module, "MERGE_ROWS", merge)
    monkeypatch.setattr(module, "MERGE_USERS", 4)
    rng = np.random.default_rng(8)
    users, items = [(i, rng.random(4)) for i in range(30)], [(100 + i, rng.random(4)) for i in range(90)]
    score = {u: {i: float(np.float32(v) @ np.float32(w)) for i, w in items} for u, v in users}
    order = {u: sorted(s, key=lambda i: (-s[i], i)) for u, s in score.items()}
    known = {u: set(order[u][:3 * (u % 4)]) for u in score} | {1: set(order[1][:40]), 2: set(order[2][3:])}
    pairs = [(u, i) for u, k in known.items() for i in k] * 2 + [(None, 101), (3, None), (777, 101), (3, 999)]
    frame = [spark.createDataFrame([(i, [float(x) for x in v]) for i, v in side], FACTORS) for side in (users, items)]
    found = top_products(*frame, 10, item_tile=tile, user_block=block, known=spark.createDataFrame(pairs, "userId int, movieId int"))
    got = {}
    for r in found.rows.orderBy("userId", "rank").collect():
        got.setdefault(r["userId"], []).append(r["movieId"])
    assert got == {u: [i for i in order[u] if i not in known[u]][:10] for u in score}


def test_quality_lists_are_full(spark, monkeypatch):
    """The measured lists hold ten items of every user, also of one who knows the thirty best."""
    rng = random.Random(2)
    rows = [(u, m, rng.choice([4.0, 4.5, 5.0]), "G", "t") for u in range(12) for m in rng.sample(range(60), 50 if u < 6 else 12)]
    rows += [(u, m, 0.5, "G", "t") for u in range(6, 12) for m in range(60, 70)]
    hybrid, seen = spark.createDataFrame(rows, HYBRID), {}

    class Tables:
        pass

    Tables.hybrid = hybrid
    monkeypatch.setattr(models, "driver_tables", lambda spark, sf: Tables)
    measure = quality.ranking_quality
    monkeypatch.setattr(quality, "ranking_quality", lambda lists, truth: seen.update(lists) or measure(lists, truth))
    assert models.ranking_quality_als(spark, "").count() == 2
    train, _ = quality.train_and_held_out(hybrid)
    catalog = train.select("movieId").distinct().count()
    left = {r[0]: min(10, catalog - r[1]) for r in train.groupBy("userId").agg(F.countDistinct("movieId")).collect()}
    assert {r[0]: r[1] for r in seen["als"].groupBy("userId").count().collect()} == left
    assert seen["als"].join(train, ["userId", "movieId"]).count() == 0


def test_only_wanted_rows_of_lists_are_written(spark):
    """The rows of a fold are those of the whole lists, by a column over the pair."""
    from marquee.operators.crossfit import fold_of
    rng = np.random.default_rng(4)
    frame = [spark.createDataFrame([(i, [float(x) for x in rng.random(3)]) for i in range(a, b)], FACTORS) for a, b in ((0, 25), (50, 110))]
    whole = top_products(*frame, 9).rows
    parts = [top_products(*frame, 9, where=fold_of(3) == f).rows for f in range(3)]
    assert sorted(map(tuple, whole.collect())) == sorted(tuple(r) for p in parts for r in p.collect())
    files = [p.inputFiles() for p in parts]
    assert all(files) and all("movieId" in spark.read.parquet(*f).columns for f in files)
