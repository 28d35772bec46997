"""Answer a whole table of free-text requests in one Spark plan.

queries(query_id, text)
  → state (missing / blank / ok) and vocabulary genres of the stripped text
  → named title (gram join on distinct normalised texts)
  → intent: seed movie, score mode, requested genre set, or a final status
  → distinct intents → stage-resolved top 10 (see operators.retrieve)
  → catalog enrichment per intent → fan back out to the requests.

Statuses: ``fallback`` for missing/blank text, for text with neither a title
nor a genre and when the catalog has no candidate; ``error`` when the named
seed movie has no genres (the reference fails on that row); else
``success`` with up to 10 ranked items.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee import schemas
from marquee.functions.text import GENRE_VOCAB, extract_genres, requested_genres, strip_text, text_state
from marquee.operators.rank import enrich_with_movies
from marquee.operators.retrieve import TOP_K, Catalog, item_scores, resolve_intents
from marquee.operators.titles import attach_titles
from marquee.session import shared_dir

# --- fixed values: status messages (own wording) ----------------------------
MSG_MISSING = "The request has no text."
MSG_BLANK = "The request holds only spaces."
MSG_NO_SIGNAL = "No known title or genre occurs in the request."
MSG_EMPTY_CATALOG = "Nothing can be suggested from this catalog."
MSG_SEED_NO_GENRES = "The named movie has no genres."
# ---------------------------------------------------------------------------


@dataclass
class RecommendResult:
    """Lazy outputs of one batch: ranked rows and one status row per request."""

    rows: DataFrame      # query_id, rank, movieId, title, genres, score, mode
    status: DataFrame    # query_id, status, message, n_recs, stage

    def responses(self) -> DataFrame:
        """One row per request with the recommendations nested in rank order.

        Each request holds at most k rows, so the per-request list is bounded.
        """
        recs = self.rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
            F.col("rank").cast("int").alias("rank"), F.col("movieId").cast("int").alias("movieId"),
            "title", "genres"))).alias("recommendations"))
        return (self.status.join(recs, on="query_id", how="left")
                .select("query_id", "status", "message",
                        F.coalesce("recommendations", F.array().cast(T.ArrayType(schemas.RECOMMENDATION)))
                        .alias("recommendations")))


def request_intents(queries: DataFrame, movies: DataFrame, vocab=GENRE_VOCAB, lookup: DataFrame | None = None) -> DataFrame:
    """Per request: pre-status (or null when eligible), seed, mode, genre set,
    and the intent key used to resolve identical intents once."""
    q = queries.select("query_id", "text").withColumn("state", text_state("text"))
    q = q.withColumn("text_genres", extract_genres(strip_text("text"), vocab))
    q = attach_titles(q, movies, "text", lookup=lookup).withColumnRenamed("movieId", "seed_id") \
        .withColumnRenamed("genres", "seed_genres")
    ok = F.col("state") == "ok"
    seed = F.when(ok, F.col("seed_id"))
    pre_status = (F.when(F.col("state") == "missing", F.struct(F.lit("fallback").alias("status"), F.lit(MSG_MISSING).alias("message")))
                  .when(F.col("state") == "blank", F.struct(F.lit("fallback").alias("status"), F.lit(MSG_BLANK).alias("message")))
                  .when(seed.isNull() & (F.size("text_genres") == 0),
                        F.struct(F.lit("fallback").alias("status"), F.lit(MSG_NO_SIGNAL).alias("message")))
                  .when(seed.isNotNull() & F.col("seed_genres").isNull(),
                        F.struct(F.lit("error").alias("status"), F.lit(MSG_SEED_NO_GENRES).alias("message"))))
    req = requested_genres(F.when(seed.isNotNull(), F.col("seed_genres")), "text_genres")
    mode = F.when(seed.isNotNull(), F.lit("title")).otherwise(F.lit("genre"))
    out = q.select("query_id", pre_status.alias("pre"), seed.alias("seed_id"), mode.alias("mode"), req.alias("req"))
    rkey = F.array_join("req", "|")
    ikey = F.concat_ws("#", F.coalesce(F.col("seed_id").cast("string"), F.lit("")), "mode", rkey)
    return out.select("query_id", "pre", "seed_id", "mode", "req", rkey.alias("rkey"),
                      F.when(F.col("pre").isNull(), ikey).alias("ikey"))


def recommend_batch(queries: DataFrame, movies: DataFrame, hybrid: DataFrame,
                    als_candidates: DataFrame, k: int = TOP_K, vocab=GENRE_VOCAB,
                    scores: DataFrame | None = None, persist_intents: bool = True,
                    ranker=None, catalog: Catalog | None = None) -> RecommendResult:
    """Recommendations for every request of ``queries``.

    A ``catalog`` (``Catalog.of``) holds all that does not depend on the
    requests; with it, a batch only searches titles and resolves its intents.

    ``scores`` (item scores) can be passed in when several batches reuse one
    catalog; it is otherwise derived from hybrid + candidates, with the
    linear scores, or with a trained pairwise ``ranker`` when given.

    The per-request intent table feeds both the distinct-intent resolution
    and the fan-out back to requests; it is written once below the shared
    checkpoint folder (``persist_intents``) instead of being recomputed per
    consumer. A repartition by intent key would let the two consumers share
    a shuffle, but would put a hot intent's requests into one task.
    """
    intents = request_intents(queries, movies, vocab, None if catalog is None else catalog.lookup)
    if persist_intents:
        spark = queries.sparkSession
        path = shared_dir(spark, "intents")
        intents.write.mode("overwrite").parquet(path)
        intents = spark.read.parquet(path)
    if scores is None and catalog is None:
        scores = item_scores(hybrid, als_candidates, ranker=ranker)
    distinct_intents = intents.filter(F.col("ikey").isNotNull()).select(
        "ikey", "seed_id", "mode", "rkey", "req").distinct()
    resolved = resolve_intents(distinct_intents, scores, k, catalog).withColumnRenamed("okey", "score")
    # Every row of an intent carries the same (chosen) stage, so the status
    # counts and the stage come from one aggregate over the enriched rows.
    per_intent = enrich_with_movies(resolved.select("ikey", "rank", "movieId", "genres", "score", "stage"),
                                    movies, ["ikey"])
    n_recs = per_intent.groupBy("ikey").agg(F.count(F.lit(1)).alias("n_recs"), F.min("stage").alias("stage"))

    # Requests that are decided already have no intent: they skip the join,
    # where they would all be one key.
    found = F.coalesce("n_recs", F.lit(0)).cast("long")
    decided = intents.filter(F.col("ikey").isNull()).select(
        "query_id", F.col("pre.status").alias("status"), F.col("pre.message").alias("message"),
        F.lit(0).cast("long").alias("n_recs"), F.lit(None).cast("int").alias("stage"))
    open_ = intents.filter(F.col("ikey").isNotNull()).select("query_id", "ikey").join(n_recs, on="ikey", how="left")
    answered = open_.select(
        "query_id", F.when(found > 0, "success").otherwise("fallback").alias("status"),
        F.when(found == 0, MSG_EMPTY_CATALOG).alias("message"), found.alias("n_recs"), "stage")
    status = answered.unionByName(decided)
    rows = intents.filter(F.col("ikey").isNotNull()).select("query_id", "ikey", "mode").join(
        per_intent, on="ikey", how="inner").select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("movieId").cast("int").alias("movieId"),
        "title", "genres", "score", "mode")
    return RecommendResult(rows=rows, status=status)


def recommend_texts(texts: list[str | None], movies: DataFrame, hybrid: DataFrame,
                    als_candidates: DataFrame, scores: DataFrame | None = None,
                    k: int = TOP_K) -> DataFrame:
    """The single-call form: one response row per given text, in input order
    (``query_id`` = position), with status, message and the nested list.

    The texts are the caller's own requests (a handful typed by a user); they
    become a small request table and go through the same plan as a batch.
    """
    spark = movies.sparkSession
    q = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    return recommend_batch(q, movies, hybrid, als_candidates, k=k, scores=scores,
                           persist_intents=False).responses().orderBy("query_id")
