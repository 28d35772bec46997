"""Cross-fitting: candidates and features that did not see their own label.

The (user, item) pairs are dealt into folds by a stable hash of the pair. For
each fold a factor model is fitted on the ratings of all other folds, and this
model alone proposes and scores the pairs of the fold. So a candidate's score
never comes from a model that saw its rating, rated or not, and scores of rated
and unrated candidates have the same origin. Item statistics follow the same
rule: a pair gets the mean and count over the other folds' ratings.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.operators import als as als_ops
from marquee.operators.clean import split_bucket
from marquee.operators.features import TOP_ROWS_PER_USER, ranker_features_from_parts
from marquee.session import checkpoint_dir

# --- fixed values ------------------------------------------------------------
FOLDS = 3
FOLD_SEED = 1729  # another hash than the train/test split's
AT_ONCE = 3  # fits that run side by side
# -----------------------------------------------------------------------------


def fold_of(folds: int = FOLDS) -> F.Column:
    """Fold of a (userId, movieId) pair; all its rows share it."""
    return (split_bucket("userId", "movieId", seed=FOLD_SEED) % folds).cast("int")


def out_of_fold_candidates(hybrid: DataFrame, folds: int = FOLDS, per_user: int = als_ops.CANDIDATES_PER_USER,
                           **als_params) -> DataFrame:
    """(userId, movieId, ALS_score, fold): the best ``per_user`` pairs of every
    user; each pair's score comes from the model of its fold.

    From the model of fold f the pairs of fold f are taken among the user's
    best ``folds * per_user`` items, about ``per_user`` of them; the lists of
    all folds are cut to the best ``per_user``. Work per fold is one fit and
    one top-k, of which only the fold's pairs are written; nothing is collected. The fits do not depend on each other and
    run side by side: each is a long row of small stages, which leave cores idle.
    """
    def of_fold(fold: int) -> DataFrame:
        model = als_ops.fit_als(hybrid.filter(fold_of(folds) != fold), **als_params)
        return als_ops.candidates(model, folds * per_user, fold_of(folds) == fold).withColumn("fold", F.lit(fold))

    checkpoint_dir(hybrid.sparkSession)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        parts = list(pool.map(of_fold, range(folds)))
    w = Window.partitionBy("userId").orderBy(F.col("ALS_score").desc(), "movieId")
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= per_user).drop("_rn")


def out_of_fold_stats(hybrid: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(movieId, fold, avg_rating, rating_count) over the ratings of all other
    folds; items without any have no mean and count 0."""
    own = hybrid.withColumn("fold", fold_of(folds)).groupBy("movieId", "fold").agg(
        F.sum(F.col("rating").cast("double")).alias("s"), F.count("rating").alias("n"))
    whole = own.groupBy("movieId").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    each = whole.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    left = each.join(own, ["movieId", "fold"], "left")
    n = F.col("all_n") - F.coalesce("n", F.lit(0))
    return left.select("movieId", "fold", F.when(n > 0, (F.col("all_s") - F.coalesce("s", F.lit(0.0))) / n).alias("avg_rating"),
                       n.alias("rating_count"))


def crossfit_features(candidates: DataFrame, hybrid: DataFrame, folds: int = FOLDS, k: int = TOP_ROWS_PER_USER) -> DataFrame:
    """Ranker feature rows (see ``ranker_features``) in which no feature was
    computed with the row's own rating. The top rows of a user are chosen by
    score and item alone, so the statistics are exchanged afterwards."""
    rows = ranker_features_from_parts(candidates, hybrid, k).drop("avg_rating", "rating_count").withColumn("fold", fold_of(folds))
    out = rows.join(out_of_fold_stats(hybrid, folds), ["movieId", "fold"], "left").fillna({"avg_rating": 0, "rating_count": 0})
    return out.select("userId", "movieId", "ALS_score", "avg_rating", "rating_count", "label")
