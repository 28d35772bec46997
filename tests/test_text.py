"""Golden tests for the text and score expressions (FIXTURES §3)."""

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marquee.functions.scores import clamp_weight, confidence, sanitize
from marquee.functions.text import extract_genres, normalize_title, requested_genres, strip_text, text_state
from marquee.sources.files import read_movies_csv


def py_normalize(text: str) -> str:
    """Plain-Python statement of the rule (Unicode \\d, \\w, \\s, strip)."""
    text = re.sub(r"\(\d{4}\)", "", text)
    text = re.sub(r"[^\w\s]", "", text)
    return text.lower().strip()


def _norm_all(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", normalize_title("t").alias("n")).orderBy("i").collect()
    return [r["n"] for r in rows]


def test_unicode_titles(spark):
    titles = ["Amélie (2001)", "日本 (1950)", "x (١٩٩٩)", "Œuvre!", "Sci-Fi_x  y (1990) (2000)", "!!! (2004)"]
    assert _norm_all(spark, titles) == ["amélie", "日本", "x", "œuvre", "scifi_x  y", ""]


ALPHABET = list("abcXYZ019 _-!?.,()|'\"") + ["\u00e9", "\u0301", "\u00df", "\u03a3", "\u65e5", "\u0661", "\u0663", "\u00a0", "\u2003",
                                            "\t", "\n", "\u3000", "\u00bd", "\u216b", "\u2122", "\U0001F600", "\x1c", "\x85"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(ALPHABET), max_size=30), min_size=1, max_size=20))
def test_normalize_matches_python(spark, texts):
    assert _norm_all(spark, texts) == [py_normalize(t) for t in texts]


def test_strip_and_state(spark):
    df = spark.createDataFrame([(None,), ("",), ("   ",), ("　x ",), ("hello there",)], "t string")
    rows = df.select(text_state("t").alias("s"), strip_text("t").alias("x")).collect()
    assert [r["s"] for r in rows] == ["missing", "missing", "blank", "ok", "ok"]
    assert rows[3]["x"] == "x"


def test_extract_genres_substrings(spark):
    df = spark.createDataFrame([("award winning software",), ("Recommend comedy films",),
                                ("Matrix is an action movie",), ("Suggest emotional movies",), (None,),
                                ("SCI-FI and Western with WAR",)], "t string")
    got = [r["g"] for r in df.select(extract_genres("t").alias("g")).collect()]
    assert got == [["war"], ["comedy"], ["action"], [], [], ["sci-fi", "war", "western"]]


def test_requested_genres_union(spark):
    df = spark.createDataFrame([("Comedy|War", ["comedy", "crime"]), (None, ["drama"])],
                               "sg string, tg array<string>")
    got = [r["r"] for r in df.select(requested_genres("sg", "tg").alias("r")).collect()]
    assert got == [["comedy", "crime", "war"], ["drama"]]


def test_confidence_golden(spark):
    df = spark.createDataFrame([("genre", 1), ("genre", 3), ("genre", 5), ("genre", 7), ("movie", 0),
                                ("unknown", 0)], "t string, n int")
    got = [r["c"] for r in df.select(confidence("t", "n").alias("c")).collect()]
    assert got == [0.6, 0.8, 1.0, 1.0, 1.0, 0.0]


def test_model_score_guards(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (float("inf"),), (float("-inf"),)], "s double")
    for w, factor in [(2.0, 2.0), (0.0, 1e-6), (-1.0, 1e-6), (float("nan"), 1e-6)]:
        got = [r["x"] for r in df.select((sanitize("s") * clamp_weight(F.lit(w))).alias("x")).collect()]
        assert got[1:] == [0.0, 0.0, 0.0]
        assert math.isclose(got[0], 1.5 * factor)


def test_quoted_csv(spark, tmp_path):
    path = tmp_path / "movies.csv"
    path.write_text('movieId,title,genres\n1,"A ""quoted"", title (1999)",Drama|Action\n2,Plain (2000),Comedy\n'
                    'x,Bad id (2001),Drama\n')
    rows = read_movies_csv(spark, str(path)).orderBy("title").collect()
    assert rows[0]["title"] == 'A "quoted", title (1999)'
    assert rows[0]["genres"] == "Drama|Action" and rows[0]["movieId"] == 1
    assert [r["movieId"] for r in rows] == [1, None, 2]  # bad id → null, not a failed job


@pytest.mark.parametrize("text,expected", [("I watched Titanic", "i watched titanic")])
def test_sample_prompt_normalizes(spark, text, expected):
    assert _norm_all(spark, [text]) == [expected]
