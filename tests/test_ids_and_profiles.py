"""Quarantine, dense ids, mergeable profiles, seed-level scores, CSV build."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marquee.operators import als as als_ops
from marquee.operators import ids, retrieve
from marquee.plans.offline import build_offline
from marquee.sources import profiles
from marquee.sources.files import read_movies_csv, read_ratings_csv, read_tags_csv, write_csv

RAW = "userId string, movieId string, rating string, note string"


def test_every_rating_is_accepted_or_set_aside(spark):
    rows = [("1", "2", "3.5", "ok"), ("99999999999", "2", "5", "ok"), ("x", "y", "z", "user"), (None, "2", "3", "user"), ("1", "2.5", "3", "movie"),
            ("1", None, "3", "movie"), ("1", "2", None, "rating"), ("1", "2", "NaN", "rating"), ("1", "2", "", "rating"),
            ("1", "2", "0.4", "range"), ("1", "2", "5.1", "range"), ("1", "2", "-3", "range"), ("1", "2", "Infinity", "range"), ("1", "2", "3.5", "ok")]
    judged = ids.judged_ratings(spark.createDataFrame(rows, RAW))
    want = {"ok": None, "user": ids.NO_USER, "movie": ids.NO_MOVIE, "rating": ids.NO_RATING, "range": ids.OUT_OF_RANGE}
    assert all(r["reason"] == want[r["note"]] for r in judged.collect())
    assert ids.accepted(judged).count() + ids.quarantined(judged).count() == len(rows)
    assert ids.accepted(judged).filter("userId = 99999999999").count() == 1
    balance = {r["reason"]: r["n_rows"] for r in ids.row_balance(judged).collect()}
    assert sum(balance.values()) == len(rows) and balance["accepted"] == 3


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_dense_ids(spark, kind):
    rng = random.Random(1)
    values = [rng.randrange(-10 ** 15, 10 ** 15) for _ in range(3000)]
    values = [str(v) for v in values] if kind == "string" else values
    df = spark.createDataFrame([(v,) for v in values + values[:500] + [None]], f"id {kind}").repartition(6)
    got = {r["id"]: r["index"] for r in ids.dense_ids(df, "id").collect()}
    assert got == {v: i for i, v in enumerate(sorted(set(values)))}
    assert ids.dense_ids(df.limit(0), "id").count() == 0


def test_a_factor_model_of_large_ids(spark):
    rng = random.Random(2)
    rows = [(u * 10 ** 12 + 7, m * 10 ** 11 - 5, float(rng.randrange(1, 11)) / 2) for u in range(30) for m in range(20) if rng.random() < 0.5]
    dense, users, movies = ids.with_dense_ids(spark.createDataFrame(rows, "userId bigint, movieId bigint, rating float"))
    assert dense.count() == len(rows) and dict(dense.dtypes)["userId"] == "int"
    found = als_ops.candidates(als_ops.fit_als(dense, max_iter=2, rank=3), 5)
    named = found.join(users.withColumnRenamed("userId", "u"), found.userId == users.index).join(
        movies.withColumnRenamed("movieId", "m"), found.movieId == movies.index).select("u", "m").collect()
    assert len(named) == 5 * 30 and {r["u"] for r in named} == {r[0] for r in rows}


def test_profiles_of_parts_merge(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, rng.randrange(3000)]), f"t{rng.randrange(40)}" if i % 7 else None, [i % 5], float("nan") if i == 9 else i / 3)
            for i in range(8000)]
    df = spark.createDataFrame(rows, "a int, b int, c string, d array<int>, `e f` double")
    parts = [profiles.column_states(df.filter(F.col("a") % 3 == k), "t") for k in range(3)]
    merged = profiles.merged_states(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    whole = {r["column_name"]: r for r in profiles.column_profile(profiles.column_states(df, "t")).collect()}
    for r in profiles.column_profile(merged).collect():
        w = whole[r["column_name"]]
        assert (r["n_rows"], r["n_null"], r["low"], r["low_text"], r["high_text"]) == (w["n_rows"], w["n_null"], w["low"], w["low_text"], w["high_text"])
        assert abs(r["n_distinct"] - w["n_distinct"]) <= 0.03 * w["n_distinct"]
    exact = {"a": 8000, "b": len({x[1] for x in rows} - {None}), "c": 40, "d": 5}
    for name, n in exact.items():
        assert abs(whole[name]["n_distinct"] - n) <= 0.06 * n  # over three standard errors
    assert whole["b"]["n_null"] == sum(r[1] is None for r in rows) and whole["c"]["high_text"] == "t9"
    empty = profiles.column_profile(profiles.column_states(df.limit(0), "t")).collect()
    assert {r["n_rows"] for r in empty} == {0} and {r["n_distinct"] for r in empty} == {0}


def test_collaborative_scores(spark):
    """A third of all lists hold item 1."""
    rng = random.Random(4)
    lists = {u: {m: rng.random() for m in rng.sample(range(2, 60), 8)} | ({1: 0.5} if u % 3 == 0 else {}) for u in range(150)}
    df = spark.createDataFrame([(u, m, s) for u, v in lists.items() for m, s in v.items()], "userId int, movieId int, ALS_score double")
    seeds = [1, 5, 17, 999]
    got = defaultdict(list)
    for r in retrieve.collaborative_scores(df, spark.createDataFrame([(s,) for s in seeds], "seed_id int"), k=6).orderBy("seed_id", "rank").collect():
        got[r["seed_id"]].append((r["movieId"], r["support"], r["mean_score"], r["rank"]))
    for seed in seeds:
        reached = [v for v in lists.values() if seed in v]
        n = Counter(m for v in reached for m in v if m != seed)
        mean = {m: round(sum(v[m] for v in reached if m in v) / n[m], 6) for m in n}
        want = sorted(n, key=lambda m: (-n[m], -mean[m], m))[:6]
        assert [(m, n[m], r) for r, m in enumerate(want, 1)] == [(m, s, r) for m, s, _, r in got[seed]]
        assert all(abs(mean[m] - x) < 2e-6 for m, _, x, _ in got[seed])


def test_offline_build_from_csv(spark, small, tmp_path):
    for name, df in (("movies", small.movies), ("ratings", small.ratings), ("tags", small.tags)):
        write_csv(df, str(tmp_path / name))
    read = {"movies": read_movies_csv(spark, str(tmp_path / "movies")), "ratings": read_ratings_csv(spark, str(tmp_path / "ratings")),
            "tags": read_tags_csv(spark, str(tmp_path / "tags"))}
    for name, df in read.items():
        original = getattr(small, name)
        assert df.schema.simpleString() == original.schema.simpleString()
        assert df.exceptAll(original).count() == 0 and original.exceptAll(df).count() == 0
    built = build_offline(read["ratings"], read["movies"], read["tags"], root=str(tmp_path / "out"), als_candidates=small.als_candidates, n_trees=1)
    assert built.hybrid.exceptAll(small.hybrid).count() == 0 and built.hybrid.count() == small.hybrid.count()
    assert len(built.ranker.trees) == 1
    assert spark.read.parquet(str(tmp_path / "out" / "ranking_dataset")).count() == built.ranking.count()
