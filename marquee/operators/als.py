"""Collaborative candidates with ALS (explicit ratings, non-negative).

The method is that of MLlib's ``ALS``: the same first factors (its random
numbers per block), the same normal equations and the same projected conjugate
gradients, in double precision. What differs is how the data lie, since MLlib shuffles the
factors of one side to every block of the other twenty times and keeps those files until
the end, and its tasks hold a whole block:

* ratings are dealt twice, by user and by item, into parts of about ``PART_ROWS`` rows,
  however many; a part is one packed row and stays where it was written;
* factors are packed rows of a table. A half-iteration gives each part all
  factors of the other side, read from their files (``each_with_all``), of which a
  task keeps those that its ratings name. Nothing is shuffled; a table of factors
  is deleted when the next of its side is there.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators import blocks
from marquee.operators.clean import als_triples
from marquee.operators.top_products import top_products
from marquee.session import checkpoint_dir, shared_dir, short_shuffles

# What runs in tasks travels by value: workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(blocks)

# --- fixed values (reference ALS parameters) --------------------------------
RANK = 20
MAX_ITER = 10
REG_PARAM = 0.1
CANDIDATES_PER_USER = 50
# ---------------------------------------------------------------------------
SEED = 42
# MLlib seeds the factors per block, so the number of blocks is part of the
# model: it is fixed here and does not follow the cluster. It bounds nothing else.
BLOCKS = 16
# Ratings of a part, and of the least part worth a task.
PART_ROWS = 1_500_000
LEAST_ROWS = 20_000
# Ratings and unknown vectors that a task solves at once.
SOLVED_ROWS = 100_000
SOLVED_AT_ONCE = 2048

DEALT = "part int, ids binary, counts binary, others binary, times binary, sums binary"


def fit_als(hybrid: DataFrame, rank: int = RANK, max_iter: int = MAX_ITER, reg_param: float = REG_PARAM,
            seed: int = SEED, num_blocks: int = BLOCKS) -> ALSModel:
    """Fit on the (userId, movieId, rating) rows of the hybrid table.

    The rows keep the tag repetition of the hybrid table (reference parity).
    Factors equal MLlib's up to single precision (a test compares them); they do not
    depend on the order of the rows, nor on the number of parts.
    """
    spark = hybrid.sparkSession
    checkpoint_dir(spark)
    triples = als_triples(hybrid).select(_id("userId"), _id("movieId"), F.col("rating").cast("float").alias("rating"))
    als = ALS(userCol="userId", itemCol="movieId", ratingCol="rating", coldStartStrategy="drop",
              nonnegative=True, rank=rank, maxIter=0, regParam=reg_param, seed=seed, numUserBlocks=num_blocks, numItemBlocks=num_blocks)
    base = shared_dir(spark, "als")
    with short_shuffles(spark):
        parts = _parts(spark, triples.count())
        by_user = _dealt(triples, "userId", "movieId", parts, f"{base}/by_user")
        by_item = _dealt(triples, "movieId", "userId", parts, f"{base}/by_item")
        # MLlib's first factors of a user depend on the ids of the users alone.
        users = _user_ids(by_user).select("userId", F.lit(0).alias("movieId"), F.lit(0.0).cast("float").alias("rating"))
        first = als.fit(users)
        if max_iter == 0:
            return first
        at = {"user": f"{base}/user-0"}
        user_factors = blocks.written(first.userFactors.mapInArrow(_pack, blocks.FACTORS), at["user"])
        for i in range(max_iter):
            item_factors = _half(spark, by_item, user_factors, parts, rank, reg_param, at, "item", f"{base}/item-{i + 1}")
            user_factors = _half(spark, by_user, item_factors, parts, rank, reg_param, at, "user", f"{base}/user-{i + 1}")
            spark._jvm.System.gc()  # plans of many scans leave much behind in the driver
        kept = [blocks.written(f.mapInArrow(_unpack, "id int, features array<float>"), f"{base}/{name}")
                for name, f in (("userFactors", user_factors), ("itemFactors", item_factors))]
    for path in (f"{base}/by_user", f"{base}/by_item", *at.values()):
        blocks.dropped(spark, path)
    made = spark._jvm.org.apache.spark.ml.recommendation.ALSModel(f"ALS_{uuid4().hex[:12]}", rank, *[f._jdf for f in kept])
    return ALSModel._from_java(made.setUserCol("userId").setItemCol("movieId").setPredictionCol("prediction").setColdStartStrategy("drop"))


def _id(column: str) -> F.Column:
    """As in MLlib, ids are whole numbers of 32 bits; others are an error."""
    c = F.col(column)
    whole = c.try_cast("int")
    wrong = F.raise_error(F.concat(F.lit(f"{column} must hold integers, not "), c.cast("string"))).cast("int")
    return F.when(whole == c, whole).otherwise(wrong).alias(column)


def _parts(spark: SparkSession, rows: int) -> int:
    return max(1, -(-rows // PART_ROWS), min(spark.sparkContext.defaultParallelism, rows // LEAST_ROWS))


def _dealt(triples: DataFrame, own: str, other: str, parts: int, path: str) -> DataFrame:
    """The ratings dealt by ``own``, one packed row a part: its ids, the items of each,
    how often each pair comes and the sum of its ratings."""
    rows = triples.select(F.pmod(F.xxhash64(own), F.lit(parts)).cast("int").alias("part"), F.col(own).alias("own"), F.col(other).alias("other"), "rating")
    return blocks.written(rows.repartitionById(parts, "part").mapInArrow(_deal, DEALT), path, by="part")


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "own", "other", "rating")] for b in batches if b.num_rows]
    if not held:
        return
    part, own, other, rating = (np.concatenate(c) for c in zip(*held, strict=True))
    held.clear()
    key = (own.astype(np.int64) << 32) | (other.astype(np.int64) & 0xFFFFFFFF)
    # Equal pairs by rating, so their sum does not depend on the order of the rows.
    order = np.lexsort((rating, key))
    key, rating = key[order], rating[order].astype(np.float64)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    pairs = key[starts]
    ids, counts = np.unique((pairs >> 32).astype(np.int32), return_counts=True)
    times = np.diff(np.append(starts, len(key)))
    cells = {"ids": ids, "counts": counts.astype(np.int32), "others": (pairs & 0xFFFFFFFF).astype(np.uint32).view(np.int32),
             "times": times.astype(np.int32), "sums": np.add.reduceat(rating, starts)}
    yield pa.RecordBatch.from_pydict({"part": pa.array(part[:1].astype(np.int32)), **{
        c: pa.array([v.tobytes()], pa.binary()) for c, v in cells.items()}})


def _user_ids(by_user: DataFrame) -> DataFrame:
    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column("ids"):
                yield pa.RecordBatch.from_pydict({"userId": pa.array(blocks.ints(cell))})

    return by_user.select("ids").mapInArrow(ids, "userId int")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield blocks.packed(*blocks.vectors(batch, "id", "features"))


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            ids, flat = blocks.ints(batch.column("ids")[row]), blocks.ints(batch.column("factors")[row], np.float32)
            ends = np.arange(len(ids) + 1, dtype=np.int32) * (len(flat) // max(1, len(ids)))
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids), "features": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})


def _half(spark: SparkSession, dealt: DataFrame, factors: DataFrame, parts: int, rank: int, reg_param: float,
          at: dict[str, str], side: str, path: str) -> DataFrame:
    """The factors of one side from those of the other, written to ``path``; ``at`` holds
    where the last ones of each side lie."""
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {c: batch.column(c)[row] for c in batch.schema.names}
                if cell["counts"].is_valid:
                    part = Part(cell, rank)
                    for early in waiting:
                        part.take(*early)
                    waiting = []
                else:
                    found = blocks.ints(cell["ids"]), blocks.ints(cell["factors"], np.float32).reshape(-1, rank)
                    waiting.append(found) if part is None else part.take(*found)
        if part is not None:
            yield blocks.packed(part.ids, part.solved(reg_param))

    rows = blocks.each_with_all(dealt, factors, parts)
    out = blocks.written(rows.mapInArrow(solve, blocks.FACTORS), path)
    if side in at:
        blocks.dropped(spark, at[side])
    at[side] = path
    return out


class Part:
    """The ratings of one part and the vectors that they name."""

    def __init__(self, cell: dict[str, pa.Scalar], rank: int):
        self.ids, self.counts = blocks.ints(cell["ids"]), blocks.ints(cell["counts"])
        self.times, self.sums = blocks.ints(cell["times"]), blocks.ints(cell["sums"], np.float64)
        others = blocks.ints(cell["others"])
        self.needed = np.unique(others)
        self.place = np.searchsorted(self.needed, others).astype(np.int32)
        self.vectors, self.missing = np.zeros((len(self.needed), rank), np.float32), len(self.needed)

    def take(self, ids: np.ndarray, factors: np.ndarray) -> None:
        at = np.minimum(np.searchsorted(self.needed, ids), len(self.needed) - 1)
        known = self.needed[at] == ids
        self.vectors[at[known]] = factors[known]
        self.missing -= int(known.sum())

    def solved(self, reg_param: float) -> np.ndarray:
        """A vector per id: least squares over its ratings, penalty by their number."""
        if self.missing:
            raise RuntimeError(f"{self.missing} vectors are missing")
        n, rank = len(self.ids), self.vectors.shape[1]
        out = np.zeros((n, rank), np.float32)
        starts = np.cumsum(self.counts, dtype=np.int64) - self.counts
        order = np.argsort(self.counts, kind="stable")
        a = 0
        while a < n:
            # Ids of like counts together, as many as bounds on ids and ratings allow.
            b = min(n, a + SOLVED_AT_ONCE)
            while b > a + 1 and (b - a) * int(self.counts[order[b - 1]]) > SOLVED_ROWS:
                b = a + (b - a) // 2
            some = order[a:b]
            ata, atb, total = self.equations(starts[some], self.counts[some].astype(np.int64), rank)
            ata[:, np.arange(rank), np.arange(rank)] += (total * reg_param)[:, None]
            out[some] = non_negative(ata, atb)
            a = b
        return out

    def equations(self, starts: np.ndarray, counts: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of x x' and of rating x x over the ratings of each id, and their number. One id
        of very many ratings goes through them in pieces."""
        ata, atb, total = np.zeros((len(starts), rank, rank)), np.zeros((len(starts), rank)), np.zeros(len(starts))
        longest, step = int(counts.max()), SOLVED_ROWS if len(starts) == 1 else int(counts.max())
        for low in range(0, longest, step):
            place = low + np.arange(min(step, longest - low))
            real = place < counts[:, None]
            at = np.where(real, starts[:, None] + place, starts[:, None])
            x = self.vectors[self.place[at]].astype(np.float64)
            times = np.where(real, self.times[at], 0).astype(np.float64)
            ata += np.matmul((x * times[:, :, None]).transpose(0, 2, 1), x)
            atb += np.matmul(np.where(real, self.sums[at], 0.0)[:, None, :], x)[:, 0]
            total += times.sum(axis=1)
        return ata, atb, total


def non_negative(ata: np.ndarray, atb: np.ndarray) -> np.ndarray:
    """Least x' A x / 2 - b' x with x >= 0 for many A and b at once, as MLlib's ``NNLS`` does
    it: projected gradients, conjugate where no wall was hit in the last steps."""
    n, rank = atb.shape
    out, live = np.zeros((n, rank)), np.arange(n)
    x, last, last_product = np.zeros((n, rank)), np.zeros((n, rank)), np.zeros((n, rank))
    last_norm, wall, over = np.ones(n), np.zeros(n, np.int64), np.zeros(n, bool)

    def product(v: np.ndarray) -> np.ndarray:
        return np.matmul(ata, v[:, :, None])[:, :, 0]

    def dot(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", u, v)

    def stop(step: np.ndarray, size: np.ndarray, x_size: np.ndarray) -> np.ndarray:
        return np.isnan(step) | (step < 1e-7) | (step > 1e40) | (size < 1e-12 * x_size) | (size < 1e-32)

    with np.errstate(all="ignore"):
        for i in range(max(400, 20 * rank)):
            rest = product(x) - atb
            grad = np.where((rest > 0) & (x == 0), 0.0, rest)
            norm, x_size = dot(grad, grad), dot(x, x)
            grad_product = product(grad)
            step = dot(grad, rest) / (dot(grad_product, grad) + 1e-20)
            alpha = (norm / last_norm)[:, None]
            way, way_product = grad + alpha * last, grad_product + alpha * last_product
            way_step, way_size = dot(way, rest) / (dot(way_product, way) + 1e-20), dot(way, way)
            conjugate = (i > wall + 1) & ~stop(way_step, way_size, x_size)
            step, size = np.where(conjugate, way_step, step), np.where(conjugate, way_size, norm)
            way = np.where(conjugate[:, None], way, grad)
            way_product = np.where(conjugate[:, None], way_product, grad_product)
            over |= stop(step, size, x_size)
            if over.sum() * 4 >= len(live) or over.all():
                out[live[over]] = x[over]
                if over.all():
                    return out
                kept = ~over
                live, x, ata, atb, wall, step = (v[kept] for v in (live, x, ata, atb, wall, step))
                way, way_product, norm, over = way[kept], way_product[kept], norm[kept], over[kept]
            # Not through a wall; what has ended stays where it is.
            step = np.minimum(step, np.where(way > 0, x / way, np.inf).min(axis=1))
            move = np.where(over, 0.0, step)[:, None] * way
            hit = move > x * (1 - 1e-14)
            x = np.where(hit, 0.0, x - move)
            wall = np.where(hit.any(axis=1), i, wall)
            last, last_product, last_norm = way, way_product, norm
    out[live] = x
    return out


def predict(model: ALSModel, triples: DataFrame) -> DataFrame:
    """(userId, movieId, rating, prediction); unseen users/items dropped."""
    return model.transform(triples)


def candidates(model: ALSModel, per_user: int = CANDIDATES_PER_USER, where: Column | None = None) -> DataFrame:
    """(userId, movieId, ALS_score): top ``per_user`` items of every user; of these the
    pairs with ``where``, if it is given.

    The lists equal ``recommendForAllUsers`` (up to the order of scores that
    agree in single precision), but items whose norm cannot reach a user's
    list are not multiplied (see ``top_products``). Already rated items are not
    excluded (reference behaviour).
    """
    found = top_products(model.userFactors, model.itemFactors, per_user, where=where)
    return found.rows.select("userId", "movieId", F.col("score").alias("ALS_score"))
