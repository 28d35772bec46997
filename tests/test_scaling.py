"""What keeps tasks and shuffles in proportion to the input: lines meet orders
once, rows are dealt once per key, partitions follow the input, packed lists."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from marquee.operators import als as als_ops
from marquee.operators import clean, crossfit, retrieve
from marquee.operators.features import ranker_features, ranker_features_from_parts
from marquee.operators.hybrid import build_hybrid, build_ranking
from marquee.operators.rank import enrich_with_movies
from marquee.sources import adapter

RATINGS = "userId int, movieId int, rating float, timestamp long"
TAGS = "userId int, movieId int, tag string, timestamp long"


@pytest.fixture
def conf(spark):
    """Sets session values for one test; what was set there is undone."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    yield spark.conf
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hybrid_of_awkward_keys(spark, conf):
    """Repeated and null keys, tags null and twice; the order of the joins and
    the way rows are dealt do not matter."""
    conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    ratings = spark.createDataFrame([(1, 1, 4.0, 0), (1, 1, 4.0, 1), (1, 2, 3.0, 0), (None, 1, 2.0, 0), (2, None, 1.0, 0), (3, 3, None, 0), (4, 9, 5.0, 0)], RATINGS)
    movies = spark.createDataFrame([(1, "A", "X|Y"), (2, "B", None), (2, "B", "Z"), (None, "N", "Q")], "movieId int, title string, genres string")
    tags = spark.createDataFrame([(1, 1, "a", 0), (1, 1, "a", 1), (1, 1, None, 0), (1, 2, "b", 0), (None, 1, "c", 0), (3, 3, "d", 0)], TAGS)
    got = sorted((tuple(r) for r in build_hybrid(ratings, movies, tags).collect()), key=repr)
    want = 2 * [(1, 1, 4.0, "X|Y", "a"), (1, 1, 4.0, "X|Y", "unknown")] + [
        (1, 2, 3.0, None, "b"), (1, 2, 3.0, "Z", "b"), (None, 1, 2.0, "X|Y", "unknown"), (2, None, 1.0, None, "unknown"),
        (4, 9, 5.0, None, "unknown")]
    assert got == sorted(want, key=repr)


def test_rows_are_dealt_once_per_pair(spark, conf):
    """The dedup of tags and the counts of labels need no shuffle besides that of the join."""
    conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    ratings = spark.createDataFrame([(1, 1, 4.0, 0)], RATINGS)
    tags = spark.createDataFrame([(1, 1, "a", 0)], TAGS)
    joined = ratings.join(clean.clean_tags(tags), ["userId", "movieId"], "left")
    assert plan(joined).count("Exchange hashpartitioning") == 2
    hybrid = spark.createDataFrame([(1, 1, 4.0, "G", "t")], "userId int, movieId int, rating float, genres string, tag string")
    candidates = spark.createDataFrame([(1, 1, 4.0)], "userId int, movieId int, ALS_score double")
    text = plan(ranker_features_from_parts(candidates, hybrid))
    assert "Exchange hashpartitioning(userId" in text
    assert not [line for line in text.splitlines() if "Exchange hashpartitioning(userId" in line and "rating" in line.split("hashpartitioning(")[1].split(")")[0]]


def test_lines_meet_orders_once(small):
    """Ratings and tags are read from one written join."""
    assert "Join" not in plan(small.ratings) and "Join" not in plan(small.tags)
    assert small.ratings.columns == ["userId", "movieId", "rating", "timestamp"]
    assert small.tags.columns == ["userId", "movieId", "tag", "timestamp"]


def test_partitions_follow_the_input(spark, conf):
    initial, split = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.files.maxPartitionBytes"
    conf.unset(initial)
    conf.set("spark.sql.shuffle.partitions", "8")
    conf.set(split, "128m")
    adapter.fit_session(spark, 1 << 20)
    assert conf.get(initial, None) is None and conf.get(split) == str(adapter.TASK_BYTES)
    adapter.fit_session(spark, 6 << 30)
    assert conf.get(initial) == "1536"
    conf.set(split, "1m")  # a session that asks for less keeps it
    adapter.fit_session(spark, 1 << 30)
    assert conf.get(split) == "1m" and conf.get(initial) == "1536"


def test_hot_seeds_give_the_same_lists(spark):
    """Seeds spread over groups or not; a null score, a null item, a null user
    and an item given twice."""
    rng = random.Random(9)
    rows = [(u, m, float(rng.randrange(10))) for u in range(60) for m in rng.sample(range(30), 6)]
    rows += [(1, 1, 2.0), (1, 1, 3.0), (2, 1, None), (None, 1, 9.0), (2, None, 9.0)]
    als = spark.createDataFrame(rows, "userId int, movieId int, ALS_score double")
    seeds = spark.createDataFrame([(s,) for s in (1, 2, 2, 3, 77, None)], "seed_id int")
    lists = [sorted(tuple(r) for r in retrieve.collaborative_scores(als, seeds, k=5, salts=3, hot=h).collect()) for h in (0, 12, 10 ** 6)]
    assert lists[0] == lists[1] == lists[2] and len(lists[0]) == 15
    pairs = retrieve.collaborative_candidates_batch(als, seeds).filter("movieId <> seed_id")
    support = {(r[0], r[1]): r[2] for r in pairs.groupBy("seed_id", "movieId").agg(F.count(F.lit(1))).collect()}
    assert all(support[s, m] == n for s, m, n, _, _ in lists[0])


def test_fits_of_all_folds_run_side_by_side(spark, monkeypatch):
    meet, fit = threading.Barrier(3), als_ops.fit_als

    def fit_together(*args, **more):
        meet.wait(60)  # broken unless all three are here
        return fit(*args, **more)

    monkeypatch.setattr(als_ops, "fit_als", fit_together)
    rng = random.Random(3)
    hybrid = spark.createDataFrame([(u, m, float(rng.randrange(1, 6)), "G", "t") for u in range(12) for m in range(12)],
                                   "userId int, movieId int, rating float, genres string, tag string")
    found = crossfit.out_of_fold_candidates(hybrid, 3, 4, max_iter=1)
    assert {r["fold"] for r in found.select("fold").collect()} <= {0, 1, 2} and found.groupBy("userId").count().agg(F.max("count")).first()[0] <= 4


def test_only_first_candidates_meet_the_labels(spark, conf):
    """A user's candidates are cut to k before the joins; candidates given twice,
    null and NaN scores, null users and items at the cut."""
    conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = [(1, 10, 0.5), (1, 10, 0.5), (1, 10, 0.5), (1, 11, None), (1, 12, float("nan")), (1, None, 0.5), (None, 10, 0.5), (None, 10, None), (2, 11, -1.0), (2, 12, None)]
    candidates = spark.createDataFrame(rows, "userId int, movieId int, ALS_score double")
    hybrid = spark.createDataFrame([(1, 10, 4.0, "A", "x"), (1, 10, 2.0, "A", "y"), (1, 11, 3.0, None, "z"), (2, 12, 1.0, "B", "x")],
                                   "userId int, movieId int, rating float, genres string, tag string")
    for k in (1, 2, 4, 20):
        got = sorted(map(repr, ranker_features_from_parts(candidates, hybrid, k).collect()))
        assert got == sorted(map(repr, ranker_features(build_ranking(candidates, hybrid), k).select(
            "userId", "movieId", "ALS_score", "avg_rating", "rating_count", "label").collect()))
    lines = plan(ranker_features_from_parts(candidates, hybrid, 2)).splitlines()
    joins = [i for i, line in enumerate(lines) if "Join" in line]
    assert any("WindowGroupLimit" in line for line in lines[joins[-1]:])


def test_intents_are_resolved_without_a_shuffle_by_intent(spark):
    """Items without an id or genres; a seed that is all there is; no item at all."""
    scores = spark.createDataFrame([(1, "A", 3.0, 1.0), (2, "A|B", 2.0, 2.0), (None, "A", 9.0, 9.0), (3, None, 1.0, 5.0), (2, "B", 2.0, 2.0)],
                                   "movieId int, genres string, score_title double, score_genre double")
    intents = spark.createDataFrame([("s", 1, "title", "a", ["a"]), ("g", None, "genre", "a", ["a"]), ("w", 2, "title", "b", ["b"]), ("n", None, "genre", "x", ["x"])],
                                    "ikey string, seed_id int, mode string, rkey string, req array<string>")
    found = retrieve.resolve_intents(intents, scores, 3)
    assert "hashpartitioning(ikey" not in plan(found)
    assert sorted(tuple(r) for r in found.collect()) == [
        ("g", 1, 1, None, "A", 9.0), ("g", 1, 2, 2, "A|B", 2.0), ("g", 1, 3, 1, "A", 1.0),
        ("n", 3, 1, None, "A", 9.0), ("n", 3, 2, 3, None, 5.0), ("n", 3, 3, 2, "A|B", 2.0),
        ("s", 1, 1, 2, "A|B", 2.0), ("w", 3, 1, 1, "A", 3.0), ("w", 3, 2, 3, None, 1.0)]
    assert retrieve.resolve_intents(intents, scores.limit(0), 3).count() == 0


def test_ranked_rows_are_dealt_once_by_group(spark, conf):
    """A movie ranked twice, one named twice in the catalog, unknown and null ones."""
    ranked = spark.createDataFrame([("g", 1, 7, "A", 5.0, 1), ("g", 2, 7, "B", 4.0, 1), ("g", 3, 8, "A", 3.0, 1), ("g", 4, None, "A", 2.0, 1), ("h", 1, 9, None, 1.0, 3)],
                                   "g string, rank int, movieId int, genres string, score double, stage int")
    movies = spark.createDataFrame([(7, "T", "C"), (8, "V", "C"), (8, "U", "D"), (None, "N", "N"), (5, "W", "C")], "movieId int, title string, genres string")
    found = enrich_with_movies(ranked, movies, ["g"]).select("g", "rank", "movieId", "title", "genres", "score", "stage")
    assert plan(found).count("Exchange hashpartitioning(g") == 1
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted([
        ("g", 1, 7, "T", "C", 5.0, 1), ("g", 2, 8, "U", "D", 3.0, 1), ("g", 3, None, None, None, 2.0, 1), ("h", 1, 9, None, None, 1.0, 3)], key=repr)


def test_edge_tables_are_written_once(small):
    assert "Join" not in plan(small.edge_hybrid) and "Join" not in plan(small.edge_item_scores)
    assert small.edge_item_scores is small.edge_item_scores


def test_tags_are_shuffled_before_they_are_exploded(spark, conf):
    """Rows of nulls and repeats give the hybrid table that the tags themselves give."""
    conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    lines = spark.createDataFrame(
        [(1, 1, 4.0, True, "a", "o"), (1, 1, 3.0, True, "a", None), (1, 2, 2.0, False, "r", "f"), (None, 1, 2.0, True, "n", "o"),
         (2, None, 1.0, None, "a", "o"), (1, 1, 4.0, True, "a", "o"), (3, 1, None, True, None, None), (3, 2, 5.0, True, None, None)],
        "userId int, movieId int, rating float, tagged boolean, flag string, status string")
    movies = spark.createDataFrame([(1, "A", "X"), (2, "B", None)], "movieId int, title string, genres string")
    ratings = adapter.ratings_of(lines)
    found = build_hybrid(ratings, movies, adapter.dealt_tags_of(lines), dealt_tags=True)
    want = build_hybrid(ratings, movies, adapter.tags_of(lines))
    text = plan(found)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect())) and found.count() == 13
    assert "Exchange hashpartitioning(userId" in text[text.index("Generate explode"):]
    # Ratings, tags and the two sides of the join with the movies; the dedup adds none.
    assert text.count("Exchange hashpartitioning") == 4


def test_stand_in_is_dealt_once_by_user(spark, conf):
    conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    ratings = spark.createDataFrame([(1, 1, 4.0), (1, 1, 2.0), (1, 2, 3.0), (1, 3, 1.0), (None, 1, 2.0), (2, None, None), (2, 5, None), (2, 6, 1.0)],
                                    "userId int, movieId int, rating float")
    found = adapter.als_standin(ratings, 2)
    assert plan(found).count("Exchange hashpartitioning") == 1
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, [
        (1, 1, 3.0), (1, 2, 3.0), (None, 1, 2.0), (2, 6, 1.0), (2, None, None)]))


def test_derived_tables_carry_no_times(spark):
    """Ratings and tags keep their times; what is written for derived tables has none."""
    t = adapter.driver_tables(spark, "/root/testdata/sf0.001", reuse=False)
    assert "timestamp" not in t.untimed_lines.columns and "rated_lines" not in t._cache
    assert "timestamp" in t.ratings.columns and "timestamp" in t.tags.columns
    assert t.untimed_lines is t.rated_lines


def test_joins_of_small_partitions_are_not_sorted(spark, conf):
    name = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before = spark.conf.get(name)
    spark.conf.unset(name)
    try:
        adapter.fit_session(spark, 1 << 20)
        assert conf.get(name) == str(adapter.TASK_BYTES)
        conf.set(name, "64m")  # a session that allows more keeps it
        adapter.fit_session(spark, 1 << 20)
        assert conf.get(name) == "64m"
    finally:
        conf.set(name, before)


def test_rows_per_seed_are_spread(spark):
    """One genre set of many seeds is the work of many tasks; null ids, a set
    without seeds and one without candidates, rows that come twice."""
    seeds = [("a", s) for s in range(40)] + [("b", 1), ("c", None), ("d", 3)]
    items = [("a", m, "G") for m in range(60)] + [("a", 7, "H"), ("a", 7, "H"), ("a", None, "G"), ("b", 1, None), ("b", 2, None), ("c", 5, "G"), ("e", 1, "G")]
    found = retrieve.rows_per_seed(spark.createDataFrame(seeds, "rkey string, seed_id int"),
                                   spark.createDataFrame(items, "rkey string, movieId int, genres string"), tasks=12)
    want = [(k, s, m, g) for k, s in seeds for x, m, g in items if k == x and None not in (s, m) and m != s]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    used = found.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(used) > 6 and max(r["n"] for r in used) < len(want) / 2
