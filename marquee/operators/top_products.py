"""Exact top k items per user by inner product, without all users x items.

For factors u and v the score u . v is at most |u| |v| (Cauchy-Schwarz). Items
are dealt into tiles by falling norm. Every user first meets the tile of the
largest norms; the k-th best score found so far, divided by |u|, is the least
norm an item needs to get into the user's list. Only tiles that hold such a
norm are multiplied, so the work follows the norms of the data; the result equals
the full product.

Scale: users are dealt into blocks by a hash, of at most ``USER_BLOCK`` users and
about ``LIST_ROWS`` places in their lists. A block is one packed row, a tile another; both lie
in tables, and a block's task reads its users and then all tiles, largest norms first
(``each_with_all``): users and items are written once, whatever the number
of blocks. The task keeps the k best so far of each user of its block and multiplies
one tile at a time, only with the users whose list the tile can still reach. Items
of equal norm are spread over several tiles by a hash, so a tile never grows with
ties. The driver holds one row per tile.

Pairs that must not be in a list (``known``) travel with their users and are left
out of every product before lists are cut, so a list is as long without them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.operators import blocks as packing

# What runs in tasks travels by value: workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(packing)

# --- fixed values ------------------------------------------------------------
ITEM_TILE = 1024
USER_BLOCK = 131_072
MIN_BLOCK = 1024
# Places in the lists of a block, tiles that one task packs, new scores held before
# they enter the lists, users whose lists are merged at once.
LIST_ROWS = 6_000_000
TILES_PER_TASK = 64
PRODUCT_ROWS = 1024
MERGE_ROWS = 2_000_000
MERGE_USERS = 4096
SLACK = 1e-5  # relative; scores are sums of single-precision products
# -----------------------------------------------------------------------------


@dataclass
class TopProducts:
    """``rows``: (userId, movieId, score, rank); ``visits``: (userId, n_items),
    the products computed for each user."""

    rows: DataFrame
    visits: DataFrame


def norm(column: str) -> F.Column:
    return F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def tiled(items: DataFrame, size: int) -> tuple[DataFrame, pd.DataFrame]:
    """Items (id, features, norm, tile) and the tiles (tile, n, norm: its
    largest), tile 0 first. Bands of falling norm come from quantiles; a band
    that is larger than a tile (equal norms) is split by a hash."""
    rows = items.select(F.col("id").alias("movieId"), "features", norm("features").alias("norm"))
    n = rows.count()
    steps = max(1, -(-n // size))
    cuts = sorted(set(rows.stat.approxQuantile("norm", [i / steps for i in range(1, steps)], 0.1 / steps)), reverse=True) if steps > 1 else []
    # The number of cuts above a norm, found by bisection in the sorted cuts.
    falling = np.array(cuts)

    def band_of(norms: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(-falling, -norms.to_numpy(), side="left"), dtype="int32")

    banded = rows.withColumn("band", F.pandas_udf(band_of, "int")("norm"))
    bands = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).orderBy("band").toPandas()
    parts = np.maximum(1, -(-bands["n"].to_numpy() // size))
    first = dict(zip(bands["band"], np.cumsum(parts) - parts, strict=True))
    held = dict(zip(bands["band"], parts, strict=True))

    def tile_of(band: pd.Series, h: pd.Series) -> pd.Series:
        base, many = (band.map(d).to_numpy().astype(np.int64) for d in (first, held))
        return pd.Series(base + h.to_numpy() % many, dtype="int32")

    placed = banded.withColumn("tile", F.pandas_udf(tile_of, "int")("band", F.pmod(F.xxhash64("movieId"), F.lit(1 << 31))))
    tiles = placed.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm")).orderBy("tile").toPandas()
    return placed.select("movieId", "features", "norm", "tile"), tiles


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best scores of each row, best first, ties by id."""
    if scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        keep = scores >= kth[:, None]
    else:
        keep = np.ones(scores.shape, bool)
    row, col = np.nonzero(keep)
    order = np.lexsort([ids[col], -scores[row, col], row])
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return np.column_stack([row, col])[rank < k]


class BestOfBlock:
    """The k best items so far of each user of a block, tile after tile."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, known: tuple[np.ndarray, np.ndarray] | None = None):
        self.ids, self.vectors, self.k = ids, vectors, k
        # (item, place of the user), by item: pairs that no list holds.
        order = np.argsort(known[0], kind="stable") if known else None
        self.known_item, self.known_row = (known[0][order], known[1][order]) if known else (None, None)
        self.length = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.bound = np.full(len(ids), -np.inf)
        self.n_items = np.zeros(len(ids), np.int64)
        self.tiles, self.next_merge, self.n_new = 0, 1, 0
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.row, self.item, self.score = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)

    def add(self, items: np.ndarray, factors: np.ndarray, norm: float) -> None:
        """Scores of a tile whose largest norm is ``norm``."""
        reached = np.flatnonzero(self.length * norm * (1 + SLACK) >= self.bound)
        self.n_items[reached] += len(items)
        out_row, out_col = self.left_out(items, reached)
        for start in range(0, len(reached), PRODUCT_ROWS):
            some = reached[start:start + PRODUCT_ROWS]
            scores = self.vectors[some] @ factors.T
            low, high = np.searchsorted(out_row, (start, start + len(some)))
            scores[out_row[low:high] - start, out_col[low:high]] = -np.inf
            row, col = np.nonzero(scores >= self.bound[some].astype(np.float32)[:, None])
            if len(row) > self.k * len(some):
                row, col = best_of(scores, items, self.k).T
            if high > low:
                fresh = scores[row, col] > -np.inf
                row, col = row[fresh], col[fresh]
            self.new.append((some[row].astype(np.int32), items[col], scores[row, col]))
            self.n_new += len(row)
            if self.n_new > MERGE_ROWS:
                self.merge()
        self.tiles += 1
        # Bounds follow a fixed series of tiles: 1, 2, 3, 4, 6, 9, 13, ...
        if self.tiles >= self.next_merge:
            self.merge()
            self.next_merge = max(self.tiles + 1, self.tiles * 3 // 2)

    def left_out(self, items: np.ndarray, reached: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``reached`` and columns of a tile's known pairs, by place."""
        if self.known_item is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, end = (np.searchsorted(self.known_item, items, side) for side in ("left", "right"))
        many = end - first
        at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        place = np.full(len(self.ids), -1, np.int64)
        place[reached] = np.arange(len(reached))
        row, col = place[self.known_row[at]], np.repeat(np.arange(len(items)), many)
        order = np.argsort(row, kind="stable")
        order = order[np.searchsorted(row[order], 0):]
        return row[order], col[order]

    def merge(self) -> None:
        """New scores enter the lists, best first, ties by id; some users at a time."""
        if not self.new:
            return
        new_row, new_item, new_score = (np.concatenate(part) for part in zip(*self.new, strict=True))
        self.new, self.n_new = [], 0
        order = np.argsort(new_row, kind="stable")
        new_row, new_item, new_score = new_row[order], new_item[order], new_score[order]
        cuts = np.arange(0, len(self.ids) + MERGE_USERS, MERGE_USERS)
        old_at, new_at = np.searchsorted(self.row, cuts), np.searchsorted(new_row, cuts)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b, c, d in zip(old_at[:-1], old_at[1:], new_at[:-1], new_at[1:], strict=True):
            row, item, score = (np.concatenate([old[a:b], new[c:d]]) for old, new in (
                (self.row, new_row), (self.item, new_item), (self.score, new_score)))
            if d > c:
                order = np.lexsort([item, -score, row])
                row, item, score = row[order], item[order], score[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                self.bound[row[rank == self.k - 1]] = score[rank == self.k - 1]
                row, item, score = row[rank < self.k], item[rank < self.k], score[rank < self.k]
            kept.append((row, item, score))
        self.row, self.item, self.score = (np.concatenate(part) for part in zip(*kept, strict=True))

    def lists(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        ends = np.searchsorted(self.row, np.arange(len(self.ids) + 1))
        for a in range(0, len(self.ids), PRODUCT_ROWS):
            b = min(a + PRODUCT_ROWS, len(self.ids))
            offsets = pa.array((ends[a:b + 1] - ends[a]).astype(np.int32))
            held = slice(ends[a], ends[b])
            yield pa.RecordBatch.from_pydict({
                "userId": pa.array(self.ids[a:b]), "movies": pa.ListArray.from_arrays(offsets, pa.array(self.item[held])),
                "scores": pa.ListArray.from_arrays(offsets, pa.array(self.score[held])), "n_items": pa.array(self.n_items[a:b])})


def blocks_of(n_users: int, parallelism: int, user_block: int) -> int:
    """Blocks of at most about ``user_block`` users; of small tables as many as
    keep the cores busy."""
    return max(1, -(-n_users // user_block), min(2 * parallelism, n_users // MIN_BLOCK))


def packed_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The users of a block as one row: ids, vectors, and known pairs as (item, place of the user)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    ids, factors = (np.concatenate(c) for c in zip(*(packing.vectors(b, "id", "features") for b in held), strict=True))
    cells = {"ids": ids.astype(np.int32), "factors": factors.astype(np.float32)}
    if "known" in held[0].schema.names:
        many = np.concatenate([b.column("known").value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for b in held])
        cells["known"] = np.concatenate([b.column("known").flatten().to_numpy(zero_copy_only=False) for b in held]).astype(np.int32)
        cells["owner"] = np.repeat(np.arange(len(ids), dtype=np.int32), many)
    yield pa.RecordBatch.from_pydict({"part": held[0].column("part").slice(0, 1), **{
        c: pa.array([v.tobytes()], pa.binary()) for c, v in cells.items()}})


def packed_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per tile, of rows sorted by tile."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    at = -1

    def one() -> pa.RecordBatch:
        ids, factors = (np.concatenate(c) for c in zip(*held, strict=True))
        return pa.RecordBatch.from_pydict({
            "tile": pa.array([at], pa.int32()), "ids": pa.array([ids.astype(np.int32).tobytes()], pa.binary()),
            "factors": pa.array([factors.astype(np.float32).tobytes()], pa.binary())})

    for batch in batches:
        tile = batch.column("tile").to_numpy()
        ids, factors = packing.vectors(batch, "movieId", "features") if len(tile) else (tile, tile)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(tile)) + 1, [len(tile)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and tile[a] != at:
                yield one()
                held = []
            at = int(tile[a])
            held.append((ids[a:b], factors[a:b]))
    if held:
        yield one()


def opened(lists: DataFrame) -> DataFrame:
    """(userId, movieId, score, rank) of packed lists."""
    return lists.select("userId", F.posexplode(F.arrays_zip("movies", "scores")).alias("at", "p")).select(
        "userId", F.col("p.movies").alias("movieId"), F.col("p.scores").alias("score"), (F.col("at") + 1).alias("rank"))


def top_products(users: DataFrame, items: DataFrame, k: int, item_tile: int = ITEM_TILE, user_block: int = USER_BLOCK,
                 known: DataFrame | None = None, where: Column | None = None) -> TopProducts:
    """The k items with the largest u . v of every user, ties by movieId;
    ``users`` and ``items`` hold (id, features). Items that a user knows, by rows
    (userId, movieId) of ``known``, are not in the user's list. Of the lists, only rows
    with ``where`` are written and returned, if it is given; ``visits`` is empty then."""
    from marquee.session import shared_dir, short_shuffles

    spark = users.sparkSession
    placed, tiles = tiled(items, item_tile)
    if not len(tiles):
        empty = users.select(F.col("id").alias("userId")).limit(0)
        none = empty.select("userId", F.lit(0).alias("movieId"), F.lit(0.0).cast("float").alias("score"), F.lit(0).alias("rank"))
        return TopProducts(none, users.select(F.col("id").alias("userId"), F.lit(0).cast("long").alias("n_items")))
    norms = dict(zip(tiles["tile"].tolist(), tiles["norm"].tolist(), strict=True))
    blocks = blocks_of(users.count(), spark.sparkContext.defaultParallelism, max(1, min(user_block, LIST_ROWS // max(1, k))))
    path = shared_dir(spark, "top-lists")
    own = users.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("part"), "id", "features")
    block_columns = "part int, ids binary, factors binary"
    if known is not None:
        lists = known.select(F.col("userId").alias("id"), "movieId").repartition("id").groupBy("id").agg(F.collect_set("movieId").alias("known"))
        own, block_columns = own.join(lists, "id", "left").select("part", "id", "features", "known"), f"{block_columns}, known binary, owner binary"
    # Tiles lie in their order in one file; the part of a tile only says which task packs it.
    several = max(1, len(tiles) // TILES_PER_TASK)
    in_order = placed.repartitionById(several, (F.col("tile") * several / F.lit(int(tiles["tile"].max()) + 1)).cast("int")).sortWithinPartitions("tile", "movieId")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {c: batch.column(c)[row] for c in batch.schema.names}
                ids = packing.ints(cell["ids"])
                factors = packing.ints(cell["factors"], np.float32).reshape(len(ids), -1)
                if cell["tile"].is_valid:
                    tile = ids, factors, norms[cell["tile"].as_py()]
                    waiting.append(tile) if block is None else block.add(*tile)
                else:
                    pairs = (packing.ints(cell["known"]), packing.ints(cell["owner"])) if "known" in cell else None
                    block = BestOfBlock(ids, factors, k, pairs)
                    for tile in waiting:
                        block.add(*tile)
                    waiting = []
        if block is not None:
            yield from block.lists()

    with short_shuffles(spark):
        of_users = packing.written(own.repartitionById(blocks, "part").mapInArrow(packed_block, block_columns), f"{path}/users", by="part")
        of_tiles = packing.written(in_order.mapInArrow(packed_tiles, "tile int, ids binary, factors binary").coalesce(1), f"{path}/tiles")
        state = packing.each_with_all(of_users, of_tiles, blocks).mapInArrow(
            best, "userId int, movies array<int>, scores array<float>, n_items long")
        kept = packing.written(state if where is None else opened(state).filter(where), f"{path}/lists")
    for name in ("users", "tiles"):
        packing.dropped(spark, f"{path}/{name}")
    if where is not None:
        return TopProducts(kept, kept.select("userId", F.lit(0).cast("long").alias("n_items")).limit(0))
    return TopProducts(opened(kept), kept.select("userId", "n_items"))
