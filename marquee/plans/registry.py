"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Every query derives the recommendation tables from the driver's tables of
``sf_dir`` (see sources.adapter) and runs over them whole. Computed doubles
are rounded to 6 places where the SQL oracle computes them another way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.text import extract_genres, normalize_title, split_genres
from marquee.operators import clean, crossfit, features, hybrid as hyb, ids, quality, retrieve
from marquee.operators.intent import parse_queries
from marquee.operators.rank import top_k
from marquee.operators.titles import match_titles
from marquee.operators.vocabulary import vocabulary_hits
from marquee.plans.offline import build_offline
from marquee.plans.recommend import recommend_batch, request_intents
from marquee.session import shared_dir
from marquee.sources import profiles
from marquee.sources.adapter import driver_tables
from marquee.sources.files import profile, read_movies_csv, read_ratings_csv, read_tags_csv, write_csv, write_parquet

Query = Callable[[SparkSession, str], DataFrame]


def _r6(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


# ---------------------------------------------------------------- sources
def scan_csv_roundtrip(spark, sf):
    t = driver_tables(spark, sf)
    path = shared_dir(spark, "movies-csv")
    write_csv(t.movies, path)
    return read_movies_csv(spark, path)


def write_parquet_roundtrip(spark, sf):
    t = driver_tables(spark, sf)
    path = shared_dir(spark, "hybrid-parquet")
    write_parquet(t.hybrid, path)
    return spark.read.parquet(path)


def profile_tables(spark, sf):
    t = driver_tables(spark, sf)
    return profile({"movies": t.movies, "ratings": t.ratings, "tags": t.tags,
                    "hybrid": t.hybrid, "als_candidates": t.als_candidates})


# ---------------------------------------------------------------- cleaning / projection
def clean_ratings(spark, sf):
    return clean.clean_ratings(driver_tables(spark, sf).ratings)


def clean_tags(spark, sf):
    return clean.clean_tags(driver_tables(spark, sf).tags)


def build_hybrid(spark, sf):
    return driver_tables(spark, sf).hybrid


def project_hybrid(spark, sf):
    return driver_tables(spark, sf).hybrid.select("userId", "movieId", "rating")


def als_triples(spark, sf):
    return clean.als_triples(driver_tables(spark, sf).hybrid)


def labels_from_ratings(spark, sf):
    return clean.labels_from_ratings(driver_tables(spark, sf).hybrid)


def item_genres(spark, sf):
    return clean.item_genres(driver_tables(spark, sf).hybrid)


def item_tags(spark, sf):
    return clean.item_tags(driver_tables(spark, sf).hybrid)


def explode_genres(spark, sf):
    m = driver_tables(spark, sf).movies
    return m.select("movieId", F.explode(split_genres("genres")).alias("genre"))


def fill_defaults(spark, sf):
    r = driver_tables(spark, sf).ranking
    return clean.fill_defaults(
        r.select("userId", "movieId", "ALS_score", "avg_rating", "rating_count", "label"),
        {"ALS_score": 0, "avg_rating": 0, "rating_count": 0, "label": 0})


def split_ratings(spark, sf):
    return clean.split_ratings(clean.als_triples(driver_tables(spark, sf).hybrid))


# ---------------------------------------------------------------- aggregates / ranking table
def movie_stats(spark, sf):
    s = hyb.movie_stats(driver_tables(spark, sf).hybrid)
    return s.select("movieId", _r6("avg_rating"), "rating_count")


def movie_stats_dedup(spark, sf):
    s = hyb.movie_stats(driver_tables(spark, sf).hybrid, dedup=True)
    return s.select("movieId", _r6("avg_rating"), "rating_count")


def build_ranking(spark, sf):
    r = driver_tables(spark, sf).ranking
    return r.select("userId", "movieId", _r6("ALS_score"), _r6("avg_rating"), "rating_count",
                    "genres", "tag", "label")


def ranking_with_stats(spark, sf):
    t = driver_tables(spark, sf)
    j = t.als_candidates.join(hyb.movie_stats(t.hybrid), on="movieId", how="left")
    return j.select("userId", "movieId", _r6("ALS_score"), _r6("avg_rating"), "rating_count")


def _scores(spark, sf):
    t = driver_tables(spark, sf)
    return retrieve.item_scores(t.hybrid, t.als_candidates)


def aggregate_candidates(spark, sf):
    s = _scores(spark, sf)
    return s.select("movieId", "genres", _r6("als"), _r6("rating"), F.col("count").cast("long").alias("count"))


def score_item_mode(spark, sf):
    return _scores(spark, sf).select("movieId", "genres", F.round("score_title", 6).alias("score"))


def score_genre_mode(spark, sf):
    return _scores(spark, sf).select("movieId", "genres", F.round("score_genre", 6).alias("score"))


def score_candidates(spark, sf):
    """Candidates ⟕ ranking aggregates (pre-aggregated per movie), both modes."""
    return _scores(spark, sf).select("movieId", "genres", F.round("score_title", 6).alias("score_title"),
                                     F.round("score_genre", 6).alias("score_genre"))


def topk_global(spark, sf):
    s = _scores(spark, sf).select("movieId", "genres", F.col("score_genre").alias("score"))
    return top_k(s).select(F.col("rank").cast("int").alias("rank"), "movieId", "genres", _r6("score"))


def enrich_topk(spark, sf):
    t = driver_tables(spark, sf)
    top = topk_global(spark, sf).select("rank", "movieId", "score")
    m = t.movies.select("movieId", "title", "genres")
    return top.join(m, on="movieId", how="left").select("rank", "movieId", "title", "genres", "score")


# ---------------------------------------------------------------- request intents
def normalize_titles(spark, sf):
    m = driver_tables(spark, sf).movies
    return m.select("movieId", normalize_title("title").alias("title_key"))


def match_titles_q(spark, sf):
    t = driver_tables(spark, sf)
    return match_titles(t.queries, t.movies)


def extract_genres_q(spark, sf):
    q = driver_tables(spark, sf).queries
    return q.select("query_id", F.array_join(extract_genres("text"), ",").alias("genres"))


def parse_query(spark, sf):
    t = driver_tables(spark, sf)
    p = parse_queries(t.queries, t.movies)
    return p.withColumn("genres", F.array_join("genres", ","))


def _eligible(spark, sf):
    t = driver_tables(spark, sf)
    return request_intents(t.queries, t.movies).filter(F.col("pre").isNull())


def requested_genres(spark, sf):
    return _eligible(spark, sf).select("query_id", "mode", "seed_id", F.col("rkey").alias("requested"))


# ---------------------------------------------------------------- retrieval
def _genre_set_rows(spark, sf, strict: bool):
    t = driver_tables(spark, sf)
    sets = _eligible(spark, sf).select("rkey", "req").distinct()
    items = retrieve.candidate_items(t.hybrid)
    m = retrieve.genre_set_matches(sets, retrieve.class_substrings(items))
    if strict:
        m = m.filter(F.col("strict"))
    return m.join(items, on="genres", how="inner").select("rkey", "movieId", "genres")


def retrieve_strict(spark, sf):
    return _genre_set_rows(spark, sf, True)


def retrieve_relaxed(spark, sf):
    return _genre_set_rows(spark, sf, False)


def retrieve_global(spark, sf):
    return retrieve.candidate_items(driver_tables(spark, sf).hybrid)


def retrieve_seed_excluded(spark, sf):
    """Candidates left per title request once its seed is removed, counted
    per item instead of listed per request (no request x catalog rows)."""
    t = driver_tables(spark, sf)
    items = retrieve.candidate_items(t.hybrid).filter(F.col("movieId").isNotNull())
    per_item = items.groupBy("movieId").agg(F.count(F.lit(1)).alias("_n_item"))
    total = items.agg(F.count(F.lit(1))).scalar()
    seeds = match_titles(t.queries, t.movies).select("query_id", F.col("movieId").alias("seed_id"))
    return seeds.join(per_item, seeds.seed_id == per_item.movieId, "left").select(
        "query_id", "seed_id", (total - F.coalesce(F.col("_n_item"), F.lit(0))).cast("long").alias("n_candidates"))


def _recommend(spark, sf):
    t = driver_tables(spark, sf)
    return recommend_batch(t.queries, t.movies, t.hybrid, t.als_candidates, scores=t.item_scores)


def recall_stage(spark, sf):
    return _recommend(spark, sf).status.filter(F.col("stage").isNotNull()).select("query_id", "stage")


def rank_item_mode(spark, sf):
    return _recommend(spark, sf).rows.filter(F.col("mode") == "title").drop("mode")


def rank_genre_mode(spark, sf):
    return _recommend(spark, sf).rows.filter(F.col("mode") == "genre").drop("mode")


def recommend_batch_q(spark, sf):
    return _recommend(spark, sf).rows.drop("mode")


def recommend_status(spark, sf):
    return _recommend(spark, sf).status.select("query_id", "status", "message", "n_recs")


def recommend_responses(spark, sf):
    return _recommend(spark, sf).responses()


def responses_flat(spark, sf):
    """The nested responses, one row per recommendation (one of nulls where
    there is none)."""
    r = _recommend(spark, sf).responses()
    return r.select("query_id", "status", "message", F.explode_outer("recommendations").alias("r")).select(
        "query_id", "status", "message", "r.rank", "r.movieId", "r.title", "r.genres")


def filter_by_genres(spark, sf):
    return retrieve.filter_by_genres(["Drama", "Romance"], driver_tables(spark, sf).hybrid)


def _seeds(spark, sf):
    t = driver_tables(spark, sf)
    return match_titles(t.queries, t.movies).select(F.col("movieId").alias("seed_id"))


def users_reached_by_item(spark, sf):
    t = driver_tables(spark, sf)
    return retrieve.users_reached_by_item(t.als_candidates, _seeds(spark, sf).select(F.col("seed_id").alias("movieId")))


def collaborative_candidates(spark, sf):
    t = driver_tables(spark, sf)
    c = retrieve.collaborative_candidates_batch(t.als_candidates, _seeds(spark, sf))
    return c.select("seed_id", "movieId", _r6("als_score"))


def explode_recommendations(spark, sf):
    """Nested per-user recommendation lists (the ALS output shape), exploded."""
    als = driver_tables(spark, sf).als_candidates
    nested = als.groupBy("userId").agg(F.collect_list(F.struct("movieId", F.col("ALS_score").alias("rating")))
                                       .alias("recommendations"))
    flat = nested.select("userId", F.explode("recommendations").alias("rec"))
    return flat.select("userId", F.col("rec.movieId").alias("movieId"),
                       F.round(F.col("rec.rating"), 6).alias("ALS_score"))


# ---------------------------------------------------------------- ranker features
def topk_features_per_user(spark, sf):
    f = driver_tables(spark, sf).ranker_features
    return f.select("userId", "movieId", _r6("ALS_score"), _r6("avg_rating"), "rating_count", "label")


def training_rows_by_user(spark, sf):
    f = features.rows_by_user(driver_tables(spark, sf).ranker_features)
    return f.select("userId", "movieId", _r6("ALS_score"), _r6("avg_rating"), "rating_count", "label")


def ranker_group_sizes(spark, sf):
    return features.group_sizes(driver_tables(spark, sf).ranker_features)


def _utility(spark, sf):
    """An unguarded exponential utility of the feature rows,
    2^(400 label) x (avg_rating - 3): labels >= 3 overflow to +/-inf, or to
    NaN when avg_rating is exactly 3 (power-of-two scaling keeps finite
    values exact in any engine)."""
    f = driver_tables(spark, sf).ranker_features
    raw = F.pow(F.lit(2.0), F.col("label").cast("double") * 400) * (F.col("avg_rating") - 3.0)
    return f.select("userId", "movieId", "label", raw.alias("raw"))


def sanitize_scores(spark, sf):
    from marquee.functions.scores import sanitize
    return _utility(spark, sf).select("userId", "movieId", "label", sanitize("raw").alias("score"))


def weighted_scores(spark, sf):
    """Sanitised utility x per-row intent weight (label - 1), clamped at 1e-6."""
    from marquee.functions.scores import clamp_weight, sanitize
    u = _utility(spark, sf)
    return u.select("userId", "movieId", "label",
                    (sanitize("raw") * clamp_weight(F.col("label") - 1)).alias("weighted_score"))


def ranker_pairs(spark, sf):
    from marquee.operators.pairwise import pair_counts
    counts = pair_counts(driver_tables(spark, sf).ranker_features)
    return counts.filter(F.col("n_pairs") > 0).select("userId", "n_pairs")


# ---------------------------------------------------------------- evaluation and cross-fitting
def ranking_quality(spark, sf):
    """Held-out quality of two lists that are the same for every user."""
    train, truth = quality.train_and_held_out(driver_tables(spark, sf).hybrid)
    lists = {"popularity": quality.popularity_list(train), "mean_rating": quality.mean_rating_list(train)}
    return quality.ranking_quality(lists, truth).select(
        "list", "n_users", _r6("ndcg"), _r6("recall"), _r6("reciprocal_rank"))


def user_quality(spark, sf):
    """The same per user, for the popularity list."""
    train, truth = quality.train_and_held_out(driver_tables(spark, sf).hybrid)
    found = quality.user_quality(quality.popularity_list(train), truth)
    return found.select("userId", _r6("ndcg"), _r6("recall"), _r6("reciprocal_rank"))


def out_of_fold_stats(spark, sf):
    s = crossfit.out_of_fold_stats(driver_tables(spark, sf).hybrid)
    return s.select("movieId", "fold", _r6("avg_rating"), "rating_count")


# ---------------------------------------------------------------- edge cases of requests
def _edge_requests(spark, sf):
    """The batch over a catalog with null genres and genres of one movie."""
    t = driver_tables(spark, sf)
    movies = t.edge_movies
    # Every movie is asked for by its title here.
    requests = movies.select(F.col("movieId").cast("long").alias("query_id"), F.col("title").alias("text"))
    return recommend_batch(requests, movies, t.edge_hybrid, t.als_candidates, scores=t.edge_item_scores).status


def recall_stage_edges(spark, sf):
    """Requests of all three stages: a seed of its own genre reaches the third."""
    return _edge_requests(spark, sf).filter(F.col("stage").isNotNull()).select("query_id", "stage")


def recommend_status_edges(spark, sf):
    """Statuses with ``error``: the named movie has no genres."""
    return _edge_requests(spark, sf).select("query_id", "status", "message", "n_recs")


def recommend_status_empty(spark, sf):
    """Statuses when nobody has rated anything: there is nothing to suggest."""
    t = driver_tables(spark, sf)
    nothing = t.hybrid.filter(F.lit(False))
    return recommend_batch(t.queries, t.movies, nothing, t.als_candidates).status.select("query_id", "status", "message", "n_recs")


def retrieve_seed_rows(spark, sf):
    """Strict candidates of every title request with its seed left out, as
    rows per distinct (genre set, seed): the seed's own class shrinks by it."""
    t = driver_tables(spark, sf)
    seeds = _eligible(spark, sf).filter("mode = 'title'").select("rkey", "seed_id").distinct()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return retrieve.rows_per_seed(seeds, retrieve_strict(spark, sf), tasks)


def collaborative_single(spark, sf):
    """The single-seed form, for the movie of id 7."""
    return retrieve.collaborative_candidates(driver_tables(spark, sf).als_candidates, 7).select("movieId", _r6("als_score"))


def collaborative_scores(spark, sf):
    t = driver_tables(spark, sf)
    c = retrieve.collaborative_scores(t.als_candidates, _seeds(spark, sf))
    return c.select("seed_id", "movieId", "support", "mean_score", "rank")


# ---------------------------------------------------------------- tables in, tables out
def offline_from_csv(spark, sf):
    """The offline build from three CSV files: the ranking table."""
    t = driver_tables(spark, sf)
    root = shared_dir(spark, "offline")
    for name, df in (("movies", t.movies), ("ratings", t.ratings), ("tags", t.tags)):
        write_csv(df, f"{root}/{name}.csv")
    built = build_offline(read_ratings_csv(spark, f"{root}/ratings.csv"), read_movies_csv(spark, f"{root}/movies.csv"),
                          read_tags_csv(spark, f"{root}/tags.csv"), root=f"{root}/tables", als_candidates=t.als_candidates)
    return built.ranking.select("userId", "movieId", _r6("ALS_score"), _r6("avg_rating"), "rating_count", "genres", "tag", "label")


def profile_columns(spark, sf):
    """Rows, nulls and bounds of every column; states of two halves merged."""
    t = driver_tables(spark, sf)
    states = None
    for name, df in (("movies", t.movies), ("ratings", t.ratings), ("tags", t.tags), ("hybrid", t.hybrid), ("queries", t.queries)):
        key = F.coalesce(F.col(df.columns[0]), F.lit(0))
        for half in (0, 1):
            part = profiles.column_states(df.filter(F.pmod(key, F.lit(2)) == half), name)
            states = part if states is None else states.unionByName(part)
    whole = profiles.column_profile(profiles.merged_states(states))
    return whole.select("table_name", "column_name", "n_rows", "n_null", "low", "high", "low_text", "high_text")


def _raw_ratings(spark, sf):
    """Ratings as texts, with ids beyond 32 bits and rows that are wrong."""
    t = driver_tables(spark, sf)
    lines = t.raw("lineitem").join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    no = F.col("l_linenumber")
    return lines.select(
        F.when(F.col("l_quantity") == 50, "nobody").otherwise((F.col("o_custkey") + 5000000000).cast("string")).alias("userId"),
        F.when(F.col("l_quantity") == 49, F.lit(None)).otherwise((F.col("l_partkey") * 7000000001).cast("string")).alias("movieId"),
        F.when(no == 7, "").when(no == 6, "9").otherwise((F.ceil(F.col("l_quantity") / 5) / 2).cast("double").cast("string")).alias("rating"))


def ratings_balance(spark, sf):
    """Accepted rows and rejected rows by reason: together all rows."""
    return ids.row_balance(ids.judged_ratings(_raw_ratings(spark, sf)))


def quarantined_ratings(spark, sf):
    return ids.quarantined(ids.judged_ratings(_raw_ratings(spark, sf))).groupBy("userId", "movieId", "rating", "reason").agg(
        F.count(F.lit(1)).alias("n_rows"))


def dense_ratings(spark, sf):
    """Accepted ratings with dense ids in place of 64-bit ones."""
    rows, _, _ = ids.with_dense_ids(ids.accepted(ids.judged_ratings(_raw_ratings(spark, sf))))
    return rows


# ---------------------------------------------------------------- long texts
def _planted_documents(spark, sf):
    """Documents as requests; every third one names a title in its middle."""
    t = driver_tables(spark, sf)
    docs = t.raw("documents").select("doc_id", "text")
    m = t.movies.select(F.col("movieId").cast("long").alias("m"), "title")
    half = (F.length("text") / 2).cast("int")
    planted = F.concat(F.substring("text", F.lit(1), half), F.lit(" "), F.col("title"), F.lit(" "),
                       F.substring("text", half + 1, F.length("text")))
    joined = docs.join(m, (F.col("doc_id") == F.col("m")) & (F.col("doc_id") % 3 == 0), "left")
    return joined.select(F.col("doc_id").alias("query_id"), F.coalesce(planted, "text").alias("text"))


def match_titles_documents(spark, sf):
    """The title join over whole documents."""
    return match_titles(_planted_documents(spark, sf), driver_tables(spark, sf).movies)


def vocabulary_documents(spark, sf):
    """Words of a vocabulary table (the words of all catalog titles and
    genres) that occur in whole documents."""
    t = driver_tables(spark, sf)
    words = t.movies.select(F.explode(F.split(F.concat_ws(" ", "title", F.regexp_replace("genres", "[|]", " ")), " ")).alias("word"))
    docs = t.raw("documents").select("doc_id", "text")
    return vocabulary_hits(docs, words, "doc_id")


def ranker_score_fixed(spark, sf):
    """Scores of a hand-made model of two trees (the model walk without a
    learned model), weighted by the label."""
    from marquee.operators.pairwise import PairwiseRanker, Tree, score_rows
    one = Tree([("split", 0, 3.0, 1, 2), ("leaf", -1.0), ("split", 1, 2.75, 3, 4), ("leaf", 0.5), ("leaf", 2.0)])
    two = Tree([("split", 0, 20.0, 1, 2), ("leaf", 0.25), ("leaf", -0.25)])
    model = PairwiseRanker(list(features.FEATURE_COLUMNS), [(["ALS_score", "avg_rating"], one), (["rating_count"], two)], 0.5, [])
    scored = score_rows(driver_tables(spark, sf).ranker_features, model, intent_weight="label")
    return scored.select("userId", "movieId", "label", "score")


QUERIES: dict[str, Query] = {
    "scan_csv_roundtrip": scan_csv_roundtrip,
    "write_parquet_roundtrip": write_parquet_roundtrip,
    "profile_tables": profile_tables,
    "clean_ratings": clean_ratings,
    "clean_tags": clean_tags,
    "build_hybrid": build_hybrid,
    "project_hybrid": project_hybrid,
    "als_triples": als_triples,
    "labels_from_ratings": labels_from_ratings,
    "item_genres": item_genres,
    "item_tags": item_tags,
    "explode_genres": explode_genres,
    "fill_defaults": fill_defaults,
    "split_ratings": split_ratings,
    "movie_stats": movie_stats,
    "movie_stats_dedup": movie_stats_dedup,
    "build_ranking": build_ranking,
    "ranking_with_stats": ranking_with_stats,
    "aggregate_candidates": aggregate_candidates,
    "score_item_mode": score_item_mode,
    "score_genre_mode": score_genre_mode,
    "score_candidates": score_candidates,
    "sanitize_scores": sanitize_scores,
    "weighted_scores": weighted_scores,
    "topk_global": topk_global,
    "enrich_topk": enrich_topk,
    "normalize_titles": normalize_titles,
    "match_titles": match_titles_q,
    "extract_genres": extract_genres_q,
    "parse_query": parse_query,
    "requested_genres": requested_genres,
    "retrieve_strict": retrieve_strict,
    "retrieve_relaxed": retrieve_relaxed,
    "retrieve_global": retrieve_global,
    "retrieve_seed_excluded": retrieve_seed_excluded,
    "recall_stage": recall_stage,
    "rank_item_mode": rank_item_mode,
    "rank_genre_mode": rank_genre_mode,
    "recommend_batch": recommend_batch_q,
    "recommend_status": recommend_status,
    "filter_by_genres": filter_by_genres,
    "users_reached_by_item": users_reached_by_item,
    "collaborative_candidates": collaborative_candidates,
    "explode_recommendations": explode_recommendations,
    "topk_features_per_user": topk_features_per_user,
    "training_rows_by_user": training_rows_by_user,
    "ranker_group_sizes": ranker_group_sizes,
    "ranker_pairs": ranker_pairs,
    "ranking_quality": ranking_quality,
    "user_quality": user_quality,
    "out_of_fold_stats": out_of_fold_stats,
    "match_titles_documents": match_titles_documents,
    "vocabulary_documents": vocabulary_documents,
    "recall_stage_edges": recall_stage_edges,
    "recommend_status_edges": recommend_status_edges,
    "recommend_status_empty": recommend_status_empty,
    "retrieve_seed_rows": retrieve_seed_rows,
    "collaborative_single": collaborative_single,
    "collaborative_scores": collaborative_scores,
    "offline_from_csv": offline_from_csv,
    "profile_columns": profile_columns,
    "ratings_balance": ratings_balance,
    "quarantined_ratings": quarantined_ratings,
    "dense_ratings": dense_ratings,
    "responses_flat": responses_flat,
    "ranker_score_fixed": ranker_score_fixed,
}
