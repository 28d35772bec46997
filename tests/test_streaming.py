"""A stream of requests served by foreachBatch equals the batch answer."""

from marquee.plans.recommend import recommend_batch
from marquee.streaming.serve import serve_requests


def test_stream_equals_batch(spark, small, tmp_path):
    src = tmp_path / "requests"
    small.queries.repartition(3).write.parquet(str(src))
    stream = spark.readStream.schema("query_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(src))
    sink = tmp_path / "responses"
    q = serve_requests(stream, small.movies, small.hybrid, small.als_candidates, str(sink),
                       checkpoint_location=str(tmp_path / "ckpt"))
    q.awaitTermination(300)
    got = spark.read.parquet(str(sink)).drop("epoch")
    want = recommend_batch(small.queries, small.movies, small.hybrid, small.als_candidates).responses()
    assert got.count() == want.count() == small.queries.count()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))


def test_stream_goes_on_after_a_restart(spark, small, tmp_path):
    """The second run answers what came since, and an epoch that failed after
    it was written is written again, not twice."""
    src, sink, ckpt = (str(tmp_path / n) for n in ("requests", "responses", "ckpt"))
    first, second = small.queries.filter("query_id % 2 = 0"), small.queries.filter("query_id % 2 = 1")

    def run():
        stream = spark.readStream.schema("query_id long, text string").parquet(src)
        serve_requests(stream, small.movies, small.hybrid, small.als_candidates, sink, checkpoint_location=ckpt).awaitTermination(300)

    first.write.parquet(src)
    run()
    assert spark.read.parquet(sink).count() == first.count()
    second.write.mode("append").parquet(src)
    run()
    assert spark.read.parquet(sink).select("epoch").distinct().count() == 2
    # Undo the commit of the last epoch, as if the driver had died before it.
    for name in ("1", ".1.crc"):
        (tmp_path / "ckpt" / "commits" / name).unlink(missing_ok=True)
    run()
    got = spark.read.parquet(sink)
    assert got.count() == got.select("query_id").distinct().count() == small.queries.count()
    want = recommend_batch(small.queries, small.movies, small.hybrid, small.als_candidates).responses()
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
