"""Score and confidence column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's behaviour) -------------------
# Title (item) mode: 0.6 * als + 0.3 * rating + 0.1 * count / 1000
ITEM_MODE_WEIGHTS = (0.6, 0.3, 0.1)
# Genre mode: 0.7 * rating + 0.3 * count / 1000
GENRE_MODE_WEIGHTS = (0.7, 0.3)
POPULARITY_DIVISOR = 1000.0
# Intent confidence: 1.0 for a title; min(1, 0.5 + 0.1 * n) for n genres.
CONFIDENCE_BASE = 0.5
CONFIDENCE_PER_GENRE = 0.1
# Floor of the intent weight applied to model scores.
MIN_INTENT_WEIGHT = 1e-6
# Decimal places used for stable ordering and reported scores.
SCORE_DECIMALS = 6
# ---------------------------------------------------------------------------


def score_item_mode(als, rating, count, weights=ITEM_MODE_WEIGHTS,
                    divisor=POPULARITY_DIVISOR) -> Column:
    w_als, w_rating, w_count = weights
    return (F.col(als) * w_als + F.col(rating) * w_rating
            + (F.col(count) / divisor) * w_count)


def score_genre_mode(rating, count, weights=GENRE_MODE_WEIGHTS,
                     divisor=POPULARITY_DIVISOR) -> Column:
    w_rating, w_count = weights
    return F.col(rating) * w_rating + (F.col(count) / divisor) * w_count


def order_key(score) -> Column:
    """Score rounded for ordering, so float noise cannot reorder ties."""
    return F.round(F.col(score) if isinstance(score, str) else score, SCORE_DECIMALS)


def confidence(intent_type, n_genres) -> Column:
    """1.0 for a title, min(1, 0.5 + 0.1 n) for n genres, else 0.0."""
    t = F.col(intent_type) if isinstance(intent_type, str) else intent_type
    n = F.col(n_genres) if isinstance(n_genres, str) else n_genres
    genre_conf = F.least(F.lit(1.0), F.lit(CONFIDENCE_BASE)
                         + F.lit(CONFIDENCE_PER_GENRE) * n.cast("double"))
    return F.round(F.when(t == "movie", F.lit(1.0))
                   .when(t == "genre", genre_conf)
                   .otherwise(F.lit(0.0)), SCORE_DECIMALS)


def sanitize(score) -> Column:
    """NaN and +/-inf become 0.0."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(F.isnan(s) | (F.abs(s) == F.lit(float("inf"))), F.lit(0.0)).otherwise(s)


def clamp_weight(weight) -> Column:
    """``max(1e-6, w)`` as Python computes it: NaN gives the floor."""
    w = (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    return F.when(F.isnan(w) | w.isNull(), F.lit(MIN_INTENT_WEIGHT)) \
        .otherwise(F.greatest(F.lit(MIN_INTENT_WEIGHT), w))
