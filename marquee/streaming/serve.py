"""Serve a stream of requests with the batch plan (Structured Streaming).

Each micro-batch of (query_id, text) rows is answered by
``plans.recommend.recommend_batch``. All that does not depend on the requests
(title lookup, best items per class and of the whole catalog, substrings of the
classes) is written once when the query starts. Output is written per epoch
with overwrite semantics, so a replayed epoch (after a failure) replaces its
own output instead of duplicating it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marquee.operators.retrieve import Catalog, item_scores
from marquee.plans.recommend import recommend_batch
from marquee.session import shared_dir


def serve_requests(requests: DataFrame, movies: DataFrame, hybrid: DataFrame, als_candidates: DataFrame,
                   sink_path: str, checkpoint_location: str,
                   available_now: bool = True) -> StreamingQuery:
    """Start a streaming query answering ``requests`` (a streaming DataFrame).

    ``checkpoint_location`` is required: a restart from the same folder goes
    on with the next epoch, one from a new folder would cut the epochs anew
    and overwrite answers."""
    spark = requests.sparkSession
    scores_path = shared_dir(spark, "item-scores")
    item_scores(hybrid, als_candidates).write.mode("overwrite").parquet(scores_path)
    catalog = Catalog.of(movies, spark.read.parquet(scores_path)).written(shared_dir(spark, "catalog"))

    def answer(batch: DataFrame, epoch_id: int) -> None:
        result = recommend_batch(batch, movies, hybrid, als_candidates, persist_intents=False, catalog=catalog)
        (result.responses().withColumn("epoch", F.lit(epoch_id))
         .write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/epoch={epoch_id}"))

    writer = requests.writeStream.foreachBatch(answer).option(
        "checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
