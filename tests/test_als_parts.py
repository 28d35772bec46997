"""ALS over parts of any size against MLlib's; what a fit leaves on disk."""

import os
import random

import numpy as np
import pytest
from pyspark.ml.recommendation import ALS
from pyspark.sql import functions as F

from marquee.operators import als as als_ops
from marquee.operators import blocks

HYBRID = "userId int, movieId int, rating float, genres string, tag string"


def ratings(seed=7, users=60, items=45):
    """Negative and large ids, pairs that come several times, a user and an item of one rating."""
    rng = random.Random(seed)
    rows = [(u * 7919 - 100, m * 31 - 40, rng.randrange(1, 11) / 2, "G", "t") for u in range(users) for m in rng.sample(range(items), rng.randrange(1, 20))]
    return rows + rows[::5] + [(2**31 - 1, 3, 5.0, "G", "t"), (5, -2**31, 0.5, None, None), (None, 1, 4.0, "G", "t"), (1, None, 4.0, "G", "t"), (1, 1, None, "G", "t")]


def factors(frame):
    return {r["id"]: np.array(r["features"]) for r in frame.collect()}


@pytest.mark.parametrize(("part_rows", "solved_rows"), [(10**6, 10**5), (60, 7)])
def test_factors_equal_mllib(spark, monkeypatch, part_rows, solved_rows):
    monkeypatch.setattr(als_ops, "PART_ROWS", part_rows)
    monkeypatch.setattr(als_ops, "SOLVED_ROWS", solved_rows)  # so small that one id goes in pieces
    hybrid = spark.createDataFrame(ratings(), HYBRID)
    ours = als_ops.fit_als(hybrid, rank=6, max_iter=4, num_blocks=5)
    theirs = ALS(userCol="userId", itemCol="movieId", ratingCol="rating", nonnegative=True, rank=6, maxIter=4, regParam=0.1, seed=42,
                 numUserBlocks=5, numItemBlocks=5).fit(hybrid.select("userId", "movieId", "rating").dropna())
    for a, b in ((ours.userFactors, theirs.userFactors), (ours.itemFactors, theirs.itemFactors)):
        a, b = factors(a), factors(b)
        assert a.keys() == b.keys() and max(np.abs(a[i] - b[i]).max() for i in a) < 1e-4


def test_a_fit_shuffles_no_factors(spark, tmp_path, monkeypatch):
    """Plans of half-iterations hold no exchange, and a fit leaves the last factors alone."""
    plans, made = [], blocks.written

    def seen(df, path, by=None):
        if "/by_" not in path:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return made(df, path, by)

    monkeypatch.setattr(blocks, "written", seen)
    monkeypatch.setattr(als_ops, "shared_dir", lambda spark, name: str(tmp_path / "fit"))
    monkeypatch.setattr(als_ops, "PART_ROWS", 100)
    model = als_ops.fit_als(spark.createDataFrame(ratings(), HYBRID), rank=3, max_iter=3)
    halves = [p for p in plans if p.count("MapInArrow") and "Union" in p]
    assert len(halves) == 6 and not any("Exchange" in p for p in halves)
    assert sorted(os.listdir(tmp_path / "fit")) == ["itemFactors", "userFactors"]
    assert model.rank == 3 and model.userFactors.count() == 62


def test_each_part_meets_all_rows_in_one_task(spark, tmp_path):
    own = blocks.written(spark.range(30).select((F.col("id") % 5).cast("int").alias("part"), "id"), f"{tmp_path}/own", by="part")
    shared = blocks.written(spark.range(7).select(F.col("id").alias("other")).repartition(3), f"{tmp_path}/all")
    rows = blocks.each_with_all(own, shared, 5).withColumn("task", F.spark_partition_id())
    per = {r["task"]: (r["own"], r["other"]) for r in rows.groupBy("task").agg(F.count("id").alias("own"), F.count("other").alias("other")).collect()}
    assert sorted(per.values()) == 5 * [(6, 7)]


@pytest.mark.parametrize("bad", ["1.5D", "3000000000L"])
def test_ids_that_are_no_integers_are_an_error(spark, bad):
    rows = spark.range(4).selectExpr(f"{bad} AS userId", "id AS movieId", "1.0 AS rating")
    with pytest.raises(Exception, match="must hold integers"):
        als_ops.fit_als(rows, rank=2, max_iter=1)
