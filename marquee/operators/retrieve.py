"""Candidate retrieval in three widening stages, for a whole table of requests.

Reference semantics per request (seed movie s, requested genre set R):
candidates are the distinct (movieId, genres) rows of the hybrid table with
movieId != s; stage 1 keeps rows whose genres contain every g in R
(case-insensitive substring), stage 2 rows containing any g, stage 3 all rows;
the first non-empty stage is used and its rows are scored and cut to 10.

Batch form without a request x catalog product:
* Items are grouped by their genres string ("class"); per class and score
  mode only the best ``KEEP`` rows can ever reach a top 10 (a seed removes at
  most one row of a class, so 10 + 1 suffice), found with a WindowGroupLimit.
* Which classes a genre set matches is decided on the small table of distinct
  genre sets x genre strings by an equi-join on substrings of genre tokens (a
  requested genre never contains the '|' separator, so it occurs in a genres
  string iff it occurs inside one of its tokens).
* Per distinct genre set and stage the union of its classes' rows is cut to
  the best ``KEEP`` distinct movies, kept as one array per genre set and mode;
  per distinct intent (seed, mode, set) the seed is left out of its arrays, the
  lowest non-empty stage chosen and the top 10 taken, without a shuffle.
Everything after the item table works on distinct intents, so identical
requests (however many) are resolved once.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.scores import order_key, score_genre_mode, score_item_mode
from marquee.functions.text import split_genres
from marquee.operators.hybrid import ranking_item_scores
from marquee.operators.titles import title_lookup

TOP_K = 10
KEEP = TOP_K + 1
MODES = ("title", "genre")


# --------------------------------------------------------------------------
# Item side
# --------------------------------------------------------------------------

def candidate_items(hybrid: DataFrame) -> DataFrame:
    """Distinct (movieId, genres) of the interaction table (the catalog seen
    by retrieval: unrated items are never candidates)."""
    return hybrid.select("movieId", "genres").distinct()


def aggregate_candidates(candidates: DataFrame, item_aggregates: DataFrame) -> DataFrame:
    """(movieId, genres, als, rating, count): ranking aggregates per candidate,
    0 where the item has no ranking rows."""
    return (candidates.join(item_aggregates, on="movieId", how="left")
            .fillna({"als": 0.0, "rating": 0.0, "count": 0})
            .select("movieId", "genres", "als", "rating", "count"))


def item_scores(hybrid: DataFrame, als_candidates: DataFrame, ranker=None,
                intent_weight: float = 1.0) -> DataFrame:
    """(movieId, genres, als, rating, count, score_title, score_genre).

    With a trained ``ranker`` (operators.pairwise) both modes use its score
    of the item's (ALS_score, avg_rating, rating_count), sanitised and
    multiplied by the clamped intent weight; the model is walked by a
    vectorised Python function, one batch of items at a time.
    """
    agg = aggregate_candidates(candidate_items(hybrid), ranking_item_scores(als_candidates, hybrid))
    if ranker is None:
        return agg.select("*", score_item_mode("als", "rating", "count").alias("score_title"),
                          score_genre_mode("rating", "count").alias("score_genre"))
    from marquee.functions.scores import clamp_weight, sanitize
    feats = agg.select("*", F.col("als").alias("ALS_score"), F.col("rating").alias("avg_rating"),
                       F.col("count").cast("double").alias("rating_count"))
    model = sanitize(ranker.raw_score()) * clamp_weight(F.lit(float(intent_weight)))
    return feats.select("movieId", "genres", "als", "rating", "count", model.alias("score_title"),
                        model.alias("score_genre"))


def _long_scores(scores: DataFrame) -> DataFrame:
    modes = F.explode(F.array(
        F.struct(F.lit("title").alias("mode"), F.col("score_title").alias("score")),
        F.struct(F.lit("genre").alias("mode"), F.col("score_genre").alias("score"))))
    return scores.select("movieId", "genres", modes.alias("s")).select(
        "movieId", "genres", F.col("s.mode").alias("mode"), order_key("s.score").alias("okey"))


def class_top(scores: DataFrame, keep: int = KEEP) -> DataFrame:
    """Best ``keep`` rows per (mode, genres string); null genres is a class."""
    w = Window.partitionBy("mode", "genres").orderBy(F.col("okey").desc(), F.col("movieId").asc())
    return (_long_scores(scores).withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= keep).drop("_rn"))


def class_substrings(scores: DataFrame) -> DataFrame:
    """(genres, sub): every substring (incl. "") of every lower-cased token."""
    classes = scores.select("genres").filter(F.col("genres").isNotNull()).distinct()
    tokens = classes.select("genres", F.explode(split_genres("genres")).alias("tok")) \
        .select("genres", F.lower("tok").alias("tok"))
    n = F.length("tok")
    starts = tokens.filter(n > 0).select("genres", "tok", F.explode(F.sequence(F.lit(1), n)).alias("_p"))
    subs = starts.select("genres", "tok", "_p", F.explode(
        F.sequence(F.lit(1), F.length("tok") - F.col("_p") + 1)).alias("_l")) \
        .select("genres", F.substring("tok", F.col("_p"), F.col("_l")).alias("sub"))
    empty = classes.select("genres", F.lit("").alias("sub"))
    return subs.unionByName(empty).distinct()


def genre_set_matches(genre_sets: DataFrame, subs: DataFrame) -> DataFrame:
    """(rkey, genres, strict): classes matching a distinct genre set.

    ``genre_sets`` holds (rkey, req) with ``req`` a distinct array of
    lower-case genres. strict = every genre of the set occurs in the class.
    """
    g = genre_sets.select("rkey", F.size("req").alias("n_req"), F.explode("req").alias("g"))
    hits = g.join(subs, g.g == subs.sub, "inner")
    per = hits.groupBy("rkey", "genres").agg(F.count(F.lit(1)).alias("n_hit"), F.max("n_req").alias("n_req"))
    return per.select("rkey", "genres", (F.col("n_hit") == F.col("n_req")).alias("strict"))


# Groups that the candidates of one genre set are spread over.
SEED_SALTS = 32


def rows_per_seed(seeds: DataFrame, candidates: DataFrame, tasks: int, salts: int = SEED_SALTS) -> DataFrame:
    """(rkey, seed_id, movieId, genres): the candidates (rkey, movieId, genres) of
    every seed (rkey, seed_id), without itself.

    The rows are as many as seeds x candidates of a set, while sets are few: joined
    on the set alone, a handful of tasks would make them all. So the candidates
    of a set are spread over ``salts`` groups, each of which meets the set's seeds,
    in a number of partitions that adaptive execution does not merge.
    """
    spread = candidates.withColumn("_salt", F.pmod(F.xxhash64("movieId"), F.lit(salts))).repartition(tasks, "rkey", "_salt")
    copies = seeds.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return copies.join(spread, ["rkey", "_salt"]).filter("movieId <> seed_id").select("rkey", "seed_id", "movieId", "genres")


def _top_movies(rows: DataFrame, part_cols: list[str], keep: int) -> DataFrame:
    """Rows whose movie is among the best ``keep`` movies of its partition
    (a movie ranks by its best row)."""
    w_movie = Window.partitionBy(*part_cols, "movieId")
    w_rank = Window.partitionBy(*part_cols).orderBy(F.col("_best").desc(), F.col("movieId").asc())
    ranked = rows.withColumn("_best", F.max("okey").over(w_movie)) \
        .withColumn("_mr", F.dense_rank().over(w_rank))
    return ranked.filter(F.col("_mr") <= keep).drop("_best", "_mr")


@dataclass
class Catalog:
    """What retrieval and title search know of the catalog, whatever is asked:
    the title lookup, the best rows per (mode, class), the substrings of the
    classes' genres, and the best rows of the whole catalog."""

    lookup: DataFrame
    top: DataFrame
    substrings: DataFrame
    global_list: DataFrame

    @classmethod
    def of(cls, movies: DataFrame, scores: DataFrame, keep: int = KEEP) -> Catalog:
        top = class_top(scores, keep)
        return cls(title_lookup(movies), top, class_substrings(scores), _global_list(top, keep))

    def written(self, path: str) -> Catalog:
        """The same, kept as four tables below ``path``."""
        spark, kept = self.top.sparkSession, {}
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")
            kept[f.name] = spark.read.parquet(f"{path}/{f.name}")
        return Catalog(**kept)


def _global_list(top: DataFrame, keep: int) -> DataFrame:
    return _top_movies(top.select("mode", F.lit(3).alias("stage"), "movieId", "genres", "okey"), ["mode"], keep)


def stage_lists(genre_sets: DataFrame, scores: DataFrame | None, keep: int = KEEP, catalog: Catalog | None = None):
    """Per (rkey, mode, stage in 1, 2): the best ``keep`` movies' rows; and
    per (mode) the stage-3 (whole catalog) list."""
    top = class_top(scores, keep) if catalog is None else catalog.top
    matches = genre_set_matches(genre_sets, class_substrings(scores) if catalog is None else catalog.substrings)
    per_set = matches.join(top, on="genres", how="inner").withColumn(
        "stage", F.explode(F.when(F.col("strict"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))))
    listed = _top_movies(per_set.select("rkey", "mode", "stage", "movieId", "genres", "okey"),
                         ["rkey", "mode", "stage"], keep)
    return listed, _global_list(top, keep) if catalog is None else catalog.global_list


# --------------------------------------------------------------------------
# Request side
# --------------------------------------------------------------------------

def resolve_intents(intents: DataFrame, scores: DataFrame | None, k: int = TOP_K, catalog: Catalog | None = None) -> DataFrame:
    """Top k candidates per distinct intent.

    ``intents``: distinct (ikey, seed_id, mode, rkey, req). Returns
    (ikey, stage, rank, movieId, genres, okey); an intent without any
    candidate has no rows. A ``catalog`` made for at least k + 1 rows takes the
    place of the scores.
    """
    genre_sets = intents.select("rkey", "req").distinct()
    listed, global_list = stage_lists(genre_sets, scores, k + 1, catalog)
    keyed = intents.select("ikey", "seed_id", "mode", "rkey")
    # The stage-3 list is at most 2 modes x (k + 1) movies: a proven bound.
    offered = (keyed.join(_packed(listed, "rkey", "mode").withColumnRenamed("list", "own"), on=["rkey", "mode"], how="left")
               .join(F.broadcast(_packed(global_list, "mode").withColumnRenamed("list", "whole")), on="mode", how="left"))
    left = F.filter(F.flatten(F.array_compact(F.array("own", "whole"))),
                    lambda x: F.col("seed_id").isNull() | (x.movieId != F.col("seed_id")))
    # The lists go by stage and place, so the first row has the lowest stage. The
    # one-element array binds what is left, which is thus found once per intent.
    best = offered.select("ikey", F.transform(F.array(left), lambda x: F.slice(F.filter(
        x, lambda y: y.stage == F.get(x, F.lit(0)).stage), 1, k))[0].alias("best"))
    # Outer, as the filter Spark infers for the other form would make the lists twice more.
    rows = best.select("ikey", F.posexplode_outer("best").alias("_at", "b")).filter(F.col("_at").isNotNull())
    return rows.select("ikey", "b.stage", (F.col("_at") + 1).alias("rank"), "b.movieId", "b.genres", "b.okey")


def _packed(rows: DataFrame, *keys: str) -> DataFrame:
    """One array ``list`` per key: its rows by stage, and in a stage from best to
    worst. A list is bounded by what ``_top_movies`` keeps."""
    w = Window.partitionBy(*keys, "stage").orderBy(
        F.col("okey").desc(), F.col("movieId").asc(), F.col("genres").asc_nulls_first())
    placed = rows.withColumn("place", F.row_number().over(w))
    return placed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        "stage", "place", "movieId", "genres", "okey"))).alias("list"))


# --------------------------------------------------------------------------
# Single-request operators kept from the reference's surface
# --------------------------------------------------------------------------

def filter_by_genres(genres_list: list[str], base_df: DataFrame) -> DataFrame:
    """Distinct movieIds whose genres contain every listed genre
    (case-sensitive literal substring). Empty or blank genres raise."""
    wrong = [g for g in genres_list if not (isinstance(g, str) and g.strip())]
    if wrong or not genres_list:
        raise ValueError(f"expected one or more genre names, got {genres_list!r}")
    names = F.array(*[F.lit(g) for g in genres_list])
    return base_df.filter(F.forall(names, lambda g: F.contains("genres", g))).select("movieId").distinct()


def collaborative_candidates(als_candidates: DataFrame, movie_id: int) -> DataFrame:
    """The batch form for one seed: (movieId, als_score)."""
    if type(movie_id) is not int:
        raise TypeError(f"a movie id is an int, not {movie_id!r}")
    seed = als_candidates.sparkSession.createDataFrame([(movie_id,)], "seed_id int")
    return collaborative_candidates_batch(als_candidates, seed).drop("seed_id")


def collaborative_candidates_batch(als_candidates: DataFrame, seeds: DataFrame) -> DataFrame:
    """Batch form over a table of seed items: (seed_id, movieId, als_score).

    seeds → users reached (join on movieId) → those users' candidate rows
    (join on userId). Each user has a bounded candidate list, so the second
    join is keyed by user, not by the possibly hot seed.
    """
    s = seeds.select(F.col("seed_id").cast("int").alias("seed_id")).distinct()
    reached = (als_candidates.select("userId", F.col("movieId").alias("seed_id"))
               .join(s, on="seed_id", how="inner").distinct())
    return reached.join(als_candidates, on="userId", how="inner").select(
        "seed_id", "movieId", F.col("ALS_score").alias("als_score"))


# Lists of a seed from which on it is spread over several groups.
HOT_SEED = 4096


def collaborative_scores(als_candidates: DataFrame, seeds: DataFrame, k: int = TOP_K, salts: int = 16,
                         hot: int = HOT_SEED) -> DataFrame:
    """(seed_id, movieId, support, mean_score, rank): for every seed the k items
    that most of its users were given, then by mean score, then by movieId; the
    seed itself is left out.

    A user's list travels packed, as two arrays, once per seed in it, and is
    opened where the rows of its seed meet: the pairs of a list are never
    shuffled. A seed in more than ``hot`` lists is spread over ``salts`` groups
    first; only the sums per (seed, item, salt) of such seeds are shuffled again.
    Lists are bounded by what a user is given.
    """
    als = als_candidates.select("userId", "movieId", F.col("ALS_score").cast("double").alias("score"))
    wanted = seeds.select(F.col("seed_id").cast("int").alias("seed_id")).distinct()
    per_seed = (als.filter(F.col("userId").isNotNull()).join(wanted, F.col("movieId") == F.col("seed_id"), "left_semi")
                .groupBy(F.col("movieId").alias("seed_id")).agg((F.count(F.lit(1)) > hot).alias("hot")))
    marked = als.filter(F.col("userId").isNotNull()).join(per_seed, F.col("movieId") == F.col("seed_id"), "left")
    packed = marked.groupBy("userId").agg(F.collect_list(F.struct("movieId", "score", "hot")).alias("l")).select(
        "userId", F.col("l.movieId").alias("items"), F.col("l.score").alias("scores"),
        F.array_distinct(F.transform(F.filter("l", lambda x: x.hot.isNotNull()),
                                     lambda x: F.struct(x.movieId.alias("seed_id"), x.hot.alias("hot")))).alias("seeds"))
    lists = packed.select("userId", "items", "scores", F.explode("seeds").alias("s")).select(
        "s.seed_id", "s.hot", "items", "scores", F.pmod(F.xxhash64("userId"), F.lit(salts)).alias("_salt"))

    def sums(dealt: DataFrame, *keys: str) -> DataFrame:
        pairs = dealt.select(*keys, F.explode(F.arrays_zip("items", "scores")).alias("p"))
        return pairs.filter("p.items <> seed_id").groupBy(*keys, F.col("p.items").alias("movieId")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("p.scores").alias("s"))

    w = Window.partitionBy("seed_id").orderBy(F.col("support").desc(), F.col("mean_score").desc(), F.col("movieId"))

    def ranked(per: DataFrame) -> DataFrame:
        scored = per.select("seed_id", "movieId", F.col("n").alias("support"), F.round(F.col("s") / F.col("n"), 6).alias("mean_score"))
        return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    cold = sums(lists.filter(~F.col("hot")).select("seed_id", "items", "scores").repartition("seed_id"), "seed_id")
    salted = sums(lists.filter("hot").select("seed_id", "_salt", "items", "scores").repartition("seed_id", "_salt"), "seed_id", "_salt")
    spread = salted.groupBy("seed_id", "movieId").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return ranked(cold).unionByName(ranked(spread))


def users_reached_by_item(als_candidates: DataFrame, items: DataFrame) -> DataFrame:
    """(movieId, userId) distinct: users given each listed item."""
    return (als_candidates.select("movieId", "userId")
            .join(items.select("movieId").distinct(), on="movieId", how="left_semi").distinct())
