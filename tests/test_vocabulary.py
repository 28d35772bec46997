"""Vocabulary tables: the gram join against plain substring tests."""

import random

from pyspark.sql import functions as F

from marquee.functions.text import GENRE_VOCAB, extract_genres
from marquee.operators.vocabulary import default_vocabulary, genres_from_vocabulary, vocabulary_hits

TEXTS = [(1, "Award winning SOFTWARE"), (2, None), (3, ""), (4, "sci-fi & horror, comedy; war"), (4, "a second row of id 4"),
         (5, "Award winning SOFTWARE"), (6, "É é ÉCLAIR 日本"), (7, "x" * 700 + "western" + "y" * 700), (None, "drama")]


def hits(spark, texts, words):
    t = spark.createDataFrame(texts, "doc_id int, text string")
    v = spark.createDataFrame([(w, 1) for w in words], "word string, n int")
    return sorted((tuple(r) for r in vocabulary_hits(t, v, "doc_id").collect()), key=str)


def brute(texts, words):
    words = {w.lower() for w in words if w}
    return sorted({(i, w) for i, t in texts if t for w in words if w in t.lower()}, key=str)


def test_vocabulary_hits(spark):
    words = [*GENRE_VOCAB, "A", "war", "WAR", None, "", "éclair", "本", "soft", "winning software", "no such word"]
    assert hits(spark, TEXTS, words) == brute(TEXTS, words)
    assert hits(spark, TEXTS, []) == [] and hits(spark, [], words) == []


def test_large_vocabulary(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdeé") for _ in range(n))
    words = [word(rng.randrange(1, 14)) for _ in range(6000)]
    texts = [(i, word(rng.randrange(0, 900))) for i in range(60)]
    assert hits(spark, texts, words) == brute(texts, words)


def test_same_lists_as_the_fixed_vocabulary(spark):
    t = spark.createDataFrame([r for r in TEXTS if r[0] not in (4, None)], "doc_id int, text string")
    got = genres_from_vocabulary(t, default_vocabulary(spark), "doc_id")
    want = t.select("doc_id", extract_genres("text").alias("genres"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_nothing_is_multiplied_or_broadcast(spark):
    t = spark.createDataFrame(TEXTS, "doc_id int, text string")
    plan = vocabulary_hits(t, default_vocabulary(spark), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan
