"""Title containment: gram equi-join vs a brute-force scan."""

import re

import pytest

from marquee.operators.titles import match_titles


def _py_norm(t):
    t = re.sub(r"\(\d{4}\)", "", t)
    t = re.sub(r"[^\w\s]", "", t)
    return t.lower().strip()


def brute_force(queries, movies):
    """Longest contained normalised title; ties → least movieId position;
    duplicate keys carry the greatest movieId's data."""
    lookup = {}
    for mid, title, genres in sorted(movies, key=lambda m: m[0]):
        if title is None:
            continue
        key = _py_norm(title)
        first = lookup[key][2] if key in lookup else mid
        lookup[key] = (mid, genres, first)
    out = {}
    for qid, text in queries:
        if not text:
            continue
        qn = _py_norm(text)
        hits = [(len(k), -v[2], k, v) for k, v in lookup.items() if k in qn]
        if hits:
            _, _, k, v = max(hits)
            out[qid] = (v[0], v[1], k)
    return out


MOVIES = [
    (1, "small ring 1 (1990)", "Drama"), (12, "small ring 12 (1991)", "War"), (3, "It (2017)", "Horror"),
    (4, "Matrix, The (1999)", "Sci-Fi"), (5, "!!! (2004)", "Comedy"), (6, "Amélie (2001)", "Romance"),
    (7, "amelie (2002)", "Drama"), (8, "Amélie (2003)", "Crime"), (9, None, "Drama"), (10, "ab (2000)", "War"),
    (11, "xab (2000)", "Action"), (13, "abx (2000)", "Western"), (14, "a long title over eight chars", "Drama"),
]
QUERIES = [
    (1, "I watched small ring 12 (1991)"), (2, "small ring 1"), (3, "something with it inside"),
    (4, "the matrix"), (5, "Matrix, The"), (6, "nothing here"), (7, None), (8, ""), (9, "   "),
    (10, "AMÉLIE please"), (11, "xabx"), (12, "I love a long title over eight chars and ab"),
    (13, "!!!"), (14, "small ring 12small ring 1"),
]


@pytest.mark.parametrize("k", [2, 3, 8])
def test_gram_join_equals_brute_force(spark, k):
    m = spark.createDataFrame(MOVIES, "movieId int, title string, genres string")
    q = spark.createDataFrame(QUERIES, "query_id long, text string")
    got = {r["query_id"]: (r["movieId"], r["genres"], r["title_key"]) for r in match_titles(q, m, k).collect()}
    assert got == brute_force(QUERIES, MOVIES)
    assert got[6][2] == ""          # the empty key matches a request with no other match
    assert got[1][0] == 12          # longest title wins
    assert got[10][0] == 8          # duplicate key: greatest movieId's data


def test_adapter_queries_equal_brute_force(small):
    movies = [tuple(r) for r in small.movies.collect()]
    queries = [tuple(r) for r in small.queries.collect()]
    got = {r["query_id"]: (r["movieId"], r["genres"], r["title_key"])
           for r in match_titles(small.queries, small.movies).collect()}
    assert got == brute_force(queries, movies)


def test_trim_is_linear(spark):
    import time

    from marquee.functions.text import strip_text

    df = spark.createDataFrame([("a" + " " * 100_000 + "b  \t",)], "t string").select(strip_text("t").alias("t"))
    df.collect()
    start = time.perf_counter()
    assert df.first()["t"] == "a" + " " * 100_000 + "b" and time.perf_counter() - start < 2


def test_nothing_exploded_is_broadcast(spark, small):
    def below(node):
        yield node.nodeName()
        for k in range(node.children().size()):
            yield from below(node.children().apply(k))

    def check(node):
        if "BroadcastExchange" in node.nodeName():
            assert not any("Generate" in n for n in below(node))
        for k in range(node.children().size()):
            check(node.children().apply(k))

    from marquee.operators.titles import match_titles

    check(match_titles(small.queries, small.movies)._jdf.queryExecution().sparkPlan())


def test_pieces_grow_with_the_texts(spark):
    from marquee.operators.titles import title_lookup, title_pieces
    from marquee.sources.adapter import driver_tables

    rows = []
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        t = driver_tables(spark, sf, reuse=False)
        keys = title_lookup(t.movies).filter("klen > 0")
        from marquee.functions.text import normalize_title
        texts = t.queries.select(normalize_title("text").alias("qn")).filter("length(qn) > 0").distinct()
        rows.append(title_pieces(texts.selectExpr("md5(qn) AS tid", "qn"), keys).count())
    assert rows[1] <= 15 * rows[0]


def test_titles_across_piece_borders(spark, monkeypatch):
    """Titles of all lengths at all offsets around the borders of pieces, some
    longer than a piece; characters outside the basic plane."""
    from marquee.operators import titles
    monkeypatch.setattr(titles, "PIECE", 16)
    movies = [(1, "ab", "A"), (2, "a title of some length", "B"), (3, "x" * 50, "C"), (4, "😀é日本", "D"), (5, "q" * 16, "E"), (6, "zz" * 17, "F")]
    rng_text = "lorem ipsum dolor sit amet consectetur adipiscing elit "
    rows = []
    for n in range(0, 40):
        for _, title, _ in movies:
            rows.append((len(rows), (rng_text * 2)[:n] + title + (rng_text * 2)[: 40 - n]))
    rows.append((len(rows), "x" * 49))
    rows.append((len(rows), "é" * 15 + "😀é日本" + "\n" + "ab"))
    m = spark.createDataFrame(movies, "movieId int, title string, genres string")
    q = spark.createDataFrame(rows, "query_id long, text string")
    got = {r["query_id"]: (r["movieId"], r["genres"], r["title_key"]) for r in match_titles(q, m).collect()}
    assert got == brute_force(rows, movies)


def test_pieces_cover_a_text_once(spark):
    from marquee.operators.titles import PIECE, text_pieces
    from pyspark.sql import functions as F
    texts = ["", "é", "a" * PIECE, "b\n😀" * PIECE, "x" * (3 * PIECE + 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "tid int, qn string")
    rows = text_pieces(df, F.lit(PIECE + 3)).orderBy("tid", "piece").collect()
    for t, text in enumerate(texts):
        mine = [r for r in rows if r["tid"] == t]
        assert "".join(r["part"][: r["own"]] for r in mine) == text
        for r in mine:
            assert r["part"] == text[r["piece"] * PIECE: r["piece"] * PIECE + len(r["part"])]
            assert len(r["part"]) >= min(r["own"] + PIECE + 3, len(text) - r["piece"] * PIECE)


def test_time_grows_with_the_length(spark):
    """Texts of twice the length take about twice the time, not four times."""
    import random
    import time
    rng = random.Random(1)
    movies = spark.createDataFrame([(i, f"title number {i * 7919}", "Drama") for i in range(200)], "movieId int, title string, genres string")

    def seconds(n):
        text = "".join(rng.choice("abcdefgh é ") for _ in range(n // 2)) + " title number 79190 " + "".join(rng.choice("abcdefgh é ") for _ in range(n // 2))
        q = spark.createDataFrame([(1, text)], "query_id long, text string")
        took = []
        for _ in range(2):
            begin = time.perf_counter()
            assert match_titles(q, movies).first()["movieId"] == 10
            took.append(time.perf_counter() - begin)
        return min(took)

    seconds(20_000)
    short, long = seconds(50_000), seconds(200_000)
    assert long < 4 * 2.3 / 2 * short + 2.0, (short, long)


def test_only_possible_titles_leave_the_texts(spark):
    """No row per position: from long texts without a title next to nothing
    comes out, and a title of any length is never missed."""
    import random

    from marquee.operators.titles import title_pieces
    rng = random.Random(4)
    titles = ["".join(rng.choice("abcdefg ") for _ in range(n)) + "x" for n in range(1, 40) for _ in range(20)]
    keys = spark.createDataFrame([(t, len(t)) for t in sorted(set(titles))], "key string, klen int").filter("klen > 4")
    noise = ["".join(rng.choice("hijklmnop é😀") for _ in range(20_000)) for _ in range(20)]
    texts = [t[:700 + i] + titles[30 * i + 120] + t[700 + i:] for i, t in enumerate(noise)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts + noise)], "tid string, qn string")
    plan = title_pieces(df, keys)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    found = {(r["tid"], r["key"]) for r in plan.collect()}
    known = {t for t in titles if len(t) > 4}
    assert {(str(i), t) for i, x in enumerate(texts) for t in known if t in x} <= found
    # The filter lets pass fewer than one in a thousand positions here.
    assert len(found) < sum(map(len, texts + noise)) / 1000
