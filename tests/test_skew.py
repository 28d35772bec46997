"""A third of all requests share one text (a hot key): answers stay whole and
per-request results equal those of a single request with that text."""

from pyspark.sql import functions as F

from marquee.plans.recommend import recommend_batch


def test_hot_request_text(spark, small):
    base = small.queries
    n = base.count()
    hot = spark.range(n // 2).select((F.col("id") + 1_000_000).alias("query_id"),
                                     F.lit("Recommend comedy films").alias("text"))
    title_hot = base.filter(F.col("query_id") % 8 == 1).limit(1).select("text").first()["text"]
    hot_title = spark.range(n // 4).select((F.col("id") + 2_000_000).alias("query_id"),
                                           F.lit(title_hot).alias("text"))
    q = base.unionByName(hot).unionByName(hot_title).repartition(7)
    res = recommend_batch(q, small.movies, small.hybrid, small.als_candidates)
    rows = res.rows.cache()
    # every hot copy got the full, identical list
    per = rows.filter(F.col("query_id") >= 1_000_000).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sort_array(F.collect_list(F.struct("rank", "movieId"))).alias("lst"))
    assert per.count() == n // 2 + n // 4
    assert per.filter(F.col("query_id") < 2_000_000).select("lst").distinct().count() == 1
    assert per.filter(F.col("query_id") >= 2_000_000).select("lst").distinct().count() == 1
    assert per.filter(F.col("query_id") < 2_000_000).agg(F.min("n")).first()[0] == 10
    assert per.filter(F.col("query_id") >= 2_000_000).select("n").distinct().count() == 1
    # and equal to the answer for a single copy
    single = spark.createDataFrame([(1, "Recommend comedy films")], "query_id long, text string")
    one = recommend_batch(single, small.movies, small.hybrid, small.als_candidates).rows
    want = sorted((r["rank"], r["movieId"]) for r in one.collect())
    got = sorted((r["rank"], r["movieId"]) for r in rows.filter(F.col("query_id") == 1_000_000).collect())
    assert got == want
    # the original requests are unaffected by the hot copies
    plain = recommend_batch(base, small.movies, small.hybrid, small.als_candidates).rows
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, rows.filter(F.col("query_id") < 1_000_000).collect()))
    rows.unpersist()
