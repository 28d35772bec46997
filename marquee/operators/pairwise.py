"""Pairwise learning to rank on Spark (boosted trees, pairwise logistic loss).

Groups are users; inside a group every pair of rows with different labels
is a training pair (the higher label should score higher). For a pair
(i, j) with y_i > y_j and margin d = s_i - s_j the loss is log(1 + e^-d);
its gradient is -sigma(-d) for i (+ for j) and its curvature
sigma(d) * sigma(-d). Per round:

1. per-row gradient g and curvature h: each user group holds at most k rows
   (the feature step keeps the top 20) and is one packed row of the training
   state, so a round shuffles none of them; tasks sum the pair terms of many
   groups at once, pairs are never emitted as rows (``with_pair_gradients`` is
   the same over a table of rows);
2. features are cut into at most ``BINS`` + 1 bins once; a round needs only the
   sums of g and h per cell (the bins of the tree's features), one aggregation
   that combines before it shuffles. Cells are bounded by the bins, whatever
   the number of rows, and a regression tree (depth 6, gain and Newton leaves
   -sum g / (sum h + 1), at least weight 1 in a child) is grown on them; rows
   are sampled by a hash of what they hold, features at random;
3. every row's score moves by learning_rate x tree output.

While training, the state is a table written anew every ``CHECKPOINT_EVERY`` rounds in
place of the last one; the trees since then are walked on the bins. A whole model
(a hundred trees are too large for one generated method) is a table of nodes
of bounded size, walked by a vectorised function: all rows of a batch take one
step down a tree at a time.
"""

from __future__ import annotations

import json
import random
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions.scores import clamp_weight, sanitize
from marquee.operators.features import FEATURE_COLUMNS
from marquee.operators.blocks import dropped
from marquee.session import shared_dir, short_shuffles

# What runs in tasks travels by value: workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- fixed values (reference training parameters) --------------------------
LEARNING_RATE = 0.1
MAX_DEPTH = 6
N_TREES = 100
SUBSAMPLE = 0.8
COLSAMPLE = 0.8
LEAF_PENALTY = 1.0
MIN_CHILD_WEIGHT = 1.0
# ---------------------------------------------------------------------------
CHECKPOINT_EVERY = 5
BINS = 64
# Cells of a round that the driver holds at most.
MAX_CELLS = 500_000
# Rows of a group at most: each row meets the list of its group.
MAX_GROUP = 100


def pair_counts(features: DataFrame, group_col: str = "userId", label_col: str = "label") -> DataFrame:
    """(userId, n_rows, n_pairs): pairs with different labels, counted as
    (n^2 - sum over labels n_l^2) / 2, without forming any pair."""
    per_label = features.groupBy(group_col, label_col).agg(F.count(F.lit(1)).alias("_nl"))
    return per_label.groupBy(group_col).agg(
        F.sum("_nl").cast("long").alias("n_rows"),
        ((F.sum("_nl") * F.sum("_nl") - F.sum(F.col("_nl") * F.col("_nl"))) / 2).cast("long").alias("n_pairs"))


def _group_list() -> Column:
    """The user's (label, score) list: at most k rows per user (top-k step)."""
    w = Window.partitionBy("userId")
    return F.collect_list(F.struct(F.col("label").alias("y"), F.col("score").alias("s"))).over(w)


def _sig_neg(d: Column) -> Column:
    """sigma(-d) = 1 / (1 + e^d), clipped against overflow."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(F.greatest(d, F.lit(-50.0)), F.lit(50.0))))


def _metric_terms(lst: Column) -> list[Column]:
    """Per row, over its group's list: label-ordered pairs (y_i > y_j), those
    the scores order correctly, and their summed logistic loss."""
    y, s = F.col("label"), F.col("score")
    return [
        F.aggregate(lst, F.lit(0), lambda a, x: a + F.when(y > x.y, 1).otherwise(0)).alias("_pn"),
        F.aggregate(lst, F.lit(0), lambda a, x: a + F.when((y > x.y) & (s > x.s), 1).otherwise(0)).alias("_pok"),
        F.aggregate(lst, F.lit(0.0),
                    lambda a, x: a + F.when(y > x.y, F.log1p(F.exp(x.s - s))).otherwise(F.lit(0.0))).alias("_ploss"),
    ]


def with_pair_gradients(state: DataFrame, metrics: bool = False) -> DataFrame:
    """Adds g, h: sums over the row's label-ordered pairs inside its group
    (and, with ``metrics``, the per-row pair metric terms of the same list).

    Computed by a window over the user's bounded list and a higher-order
    ``aggregate`` (JVM-side); pairs are never materialised as rows.
    """
    y, s = F.col("label"), F.col("score")

    def g_step(acc, x):
        return acc + F.when(y > x.y, -_sig_neg(s - x.s)).when(y < x.y, _sig_neg(x.s - s)).otherwise(F.lit(0.0))

    def h_step(acc, x):
        p = _sig_neg(F.abs(s - x.s) * F.when(y > x.y, 1.0).otherwise(-1.0))
        return acc + F.when(y != x.y, p * (F.lit(1.0) - p)).otherwise(F.lit(0.0))

    out = state.withColumn("_grp", _group_list())
    extra = _metric_terms(F.col("_grp")) if metrics else []
    return out.select("*", F.aggregate("_grp", F.lit(0.0), g_step).alias("g"),
                      F.aggregate("_grp", F.lit(0.0), h_step).alias("h"), *extra).drop("_grp")


def _ratios(pairs, ok, loss) -> dict:
    if not pairs:
        return {"pair_accuracy": 0.0, "pair_loss": 0.0}
    return {"pair_accuracy": float(ok) / pairs, "pair_loss": float(loss) / pairs}


def _summarize(per_row: DataFrame) -> dict:
    return _ratios(*per_row.agg(F.sum("_pn"), F.sum("_pok"), F.sum("_ploss")).first())


def pair_metrics(scored: DataFrame) -> dict:
    """Pair accuracy and mean pairwise logistic loss, in one pass.

    accuracy = share of label-ordered pairs (y_i > y_j) with s_i > s_j;
    loss = mean of log(1 + e^-(s_i - s_j)) over the same pairs.
    """
    return _summarize(scored.withColumn("_grp", _group_list()).select(*_metric_terms(F.col("_grp"))))


def pair_accuracy(scored: DataFrame) -> float:
    return pair_metrics(scored)["pair_accuracy"]


@dataclass
class Tree:
    """Nodes of one fitted tree: leaf value or (feature, threshold, left, right)."""

    nodes: list = field(default_factory=list)

    def to_column(self, feature_cols: list[str]) -> Column:
        def build(i):
            node = self.nodes[i]
            if node[0] == "leaf":
                return F.lit(float(node[1]))
            _, feat, thr, left, right = node
            return F.when(F.col(feature_cols[feat]) <= F.lit(float(thr)), build(left)).otherwise(build(right))
        return build(0)


def bin_edges(state: DataFrame, cols: list[str]) -> list[list[float]]:
    """Up to ``BINS`` cut points per feature: even steps of the value and of
    its logarithm between least and greatest, so they do not depend on how the
    rows lie in partitions."""
    ends = state.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("a", F.min), ("b", F.max))]).first()
    out = []
    for i in range(len(cols)):
        low, high = ends[f"a{i}"], ends[f"b{i}"]
        if low is None or not high > low:
            out.append([])
            continue
        half = np.arange(1, BINS // 2 + 1) / (BINS // 2 + 1)
        cuts = np.concatenate([low + (high - low) * half, low + np.expm1(np.log1p(high - low) * half)])
        out.append(np.unique(np.round(cuts, 9)).tolist())
    return out


def grow_tree(bins: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[list[float]], max_depth: int) -> Tree:
    """A tree over cells: ``bins`` (cell x feature), sums g and h per cell.
    A row goes left where its value is at most the cut."""
    nodes: list = []

    def visit(part: np.ndarray, depth: int) -> int:
        at, total_g, total_h = len(nodes), g[part].sum(), h[part].sum()
        nodes.append(("leaf", float(-total_g / (total_h + LEAF_PENALTY))))
        best = (1e-9, None, None)
        for f, cuts in enumerate(edges if depth < max_depth else []):
            left_g = np.cumsum(np.bincount(bins[part, f], g[part], len(cuts) + 1))[:-1]
            left_h = np.cumsum(np.bincount(bins[part, f], h[part], len(cuts) + 1))[:-1]
            right_g, right_h = total_g - left_g, total_h - left_h
            gain = (left_g ** 2 / (left_h + LEAF_PENALTY) + right_g ** 2 / (right_h + LEAF_PENALTY)
                    - total_g ** 2 / (total_h + LEAF_PENALTY))
            gain = np.where((left_h >= MIN_CHILD_WEIGHT) & (right_h >= MIN_CHILD_WEIGHT), np.round(gain, 9), -1.0)
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), f, int(gain.argmax()))
        if best[1] is not None:
            left = bins[part, best[1]] <= best[2]
            nodes[at] = ("split", best[1], float(edges[best[1]][best[2]]),
                         visit(part[left], depth + 1), visit(part[~left], depth + 1))
        return at

    visit(np.arange(len(g)), 0)
    return Tree(nodes)


@dataclass
class PairwiseRanker:
    feature_cols: list[str]
    trees: list[tuple[list[str], Tree]]
    learning_rate: float
    history: list[dict]

    def node_table(self) -> tuple[np.ndarray, ...]:
        """(roots, feature, threshold, left, right, value) of all trees; a
        leaf is its own child. At most trees x 2**(depth + 1) rows."""
        roots, rows = [], []
        for cols, tree in self.trees:
            base = len(rows)
            roots.append(base)
            for i, node in enumerate(tree.nodes):
                if node[0] == "leaf":
                    rows.append((0, 0.0, base + i, base + i, float(node[1])))
                else:
                    _, feat, thr, left, right = node
                    rows.append((self.feature_cols.index(cols[feat]), float(thr), base + left, base + right, 0.0))
        columns = [np.array(c) for c in zip(*rows, strict=True)] or [np.zeros(0)] * 5
        return np.array(roots, np.int64), *columns

    def raw_score(self) -> Column:
        """Sum of the trees' outputs; a missing feature goes right."""
        roots, feature, threshold, left, right, value = self.node_table()
        rate = self.learning_rate

        def walk(*features: pd.Series) -> pd.Series:
            x = np.column_stack([f.to_numpy(dtype=float, na_value=np.nan) for f in features])
            total, every = np.zeros(len(x)), np.arange(len(x))
            for root in roots:
                node = np.full(len(x), root)
                while True:
                    down = np.where(x[every, feature[node]] <= threshold[node], left[node], right[node])
                    if (down == node).all():
                        break
                    node = down
                total += rate * value[node]
            return pd.Series(total)

        return F.pandas_udf(walk, "double")(*[F.col(c).cast("double") for c in self.feature_cols])

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the model as one JSON text below ``path``."""
        trees = [{"columns": cols, "nodes": tree.nodes} for cols, tree in self.trees]
        text = json.dumps({"feature_cols": self.feature_cols, "learning_rate": self.learning_rate,
                           "history": self.history, "trees": trees})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PairwiseRanker:
        """The model that ``save`` wrote."""
        held = json.loads(spark.read.text(path, wholetext=True).first()[0])
        trees = [(t["columns"], Tree([tuple(n) for n in t["nodes"]])) for t in held["trees"]]
        return cls(held["feature_cols"], trees, held["learning_rate"], held["history"])


# Pairs that a task holds at a time.
PAIRS_AT_ONCE = 1_000_000


def pair_terms(sizes: np.ndarray, y: np.ndarray, s: np.ndarray, metrics: bool) -> dict[str, np.ndarray]:
    """What ``with_pair_gradients`` adds, for groups of ``sizes`` rows in a row."""
    out = {c: np.zeros(len(y)) for c in (("g", "h", "_pn", "_pok", "_ploss") if metrics else ("g", "h"))}
    starts = np.cumsum(sizes) - sizes
    for m in np.unique(sizes[sizes > 1]):
        every = starts[sizes == m]
        step = max(1, PAIRS_AT_ONCE // (m * m))
        for k in range(0, len(every), step):
            at = every[k:k + step, None] + np.arange(m)
            d = s[at][:, :, None] - s[at][:, None, :]
            more, less = y[at][:, :, None] > y[at][:, None, :], y[at][:, :, None] < y[at][:, None, :]
            below = 1.0 / (1.0 + np.exp(np.clip(np.abs(d), None, 50.0)))
            # sigma(-d) where the row is above, sigma(d) where it is below.
            wrong = np.where((d >= 0) == more, below, 1.0 - below)
            wrong[d == 0] = 0.5
            out["g"][at] = np.where(more, -wrong, np.where(less, wrong, 0.0)).sum(axis=2)
            out["h"][at] = np.where(more | less, below * (1.0 - below), 0.0).sum(axis=2)
            if metrics:
                out["_pn"][at] = more.sum(axis=2)
                out["_pok"][at] = (more & (d > 0)).sum(axis=2)
                out["_ploss"][at] = np.where(more, np.log1p(np.exp(-d)), 0.0).sum(axis=2)
    return out


def row_bucket(rid: np.ndarray, number: int) -> np.ndarray:
    """``abs(xxhash64(rid, number)) % 10000`` of Spark, for many rows at once."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def rotated(h: np.ndarray, n: int) -> np.ndarray:
        return (h << np.uint64(n)) | (h >> np.uint64(64 - n))

    def final(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    start = np.uint64((42 + int(p5) + 8) % (1 << 64))
    h = final(rotated(start ^ (rotated(rid.view(np.uint64) * p2, 31) * p1), 27) * p1 + p4)
    step = np.uint64((number & 0xFFFFFFFF) * int(p1) % (1 << 64))
    h = final(rotated((h + p5 + np.uint64(4)) ^ step, 23) * p2 + p3)
    return np.abs(h.view(np.int64)) % 10000


def binned(tree: Tree, use: list[int], edges: list[list[float]]) -> list:
    """The tree's nodes with bins in place of cuts: left where bin <= cut's."""
    return [n if n[0] == "leaf" else ("split", use[n[1]], edges[use[n[1]]].index(n[2]), n[3], n[4]) for n in tree.nodes]


def moved(score: np.ndarray, bins: np.ndarray, trees: list[list], rate: float) -> np.ndarray:
    """Scores after the trees (of bins), one after the other."""
    for nodes in trees:
        part = np.zeros(len(score))
        todo = [(0, np.arange(len(score)))]
        while todo:
            at, rows = todo.pop()
            node = nodes[at]
            if node[0] == "leaf":
                part[rows] = node[1]
            elif len(rows):
                left = bins[rows, node[1]] <= node[2]
                todo += [(node[3], rows[left]), (node[4], rows[~left])]
        score = score + rate * part
    return score


def packed_groups(batch: pa.RecordBatch, n_cols: int) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Rows per group, flat columns (rid, label, score) and the rows' bins."""
    sizes = batch.column("rid").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("rid", "label", "score")}
    bins = [batch.column(f"_b{i}").flatten().to_numpy(zero_copy_only=False) for i in range(n_cols)]
    return sizes, flat, np.column_stack(bins).astype(np.int64)


def cell_sums(state: DataFrame, n_cols: int, use: list[int], trees: list[list], rate: float, number: int,
              subsample: float, metrics: bool) -> pd.DataFrame:
    """Sums of g and h of the sampled rows (and of the metric terms of all)
    per cell of the bins ``use``, after ``trees`` moved the scores. One row a
    cell and batch is shuffled."""
    names = ["g", "h", *(["_pn", "_pok", "_ploss"] if metrics else [])]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, flat, bins = packed_groups(batch, n_cols)
            terms = pair_terms(sizes, flat["label"].astype(float), moved(flat["score"], bins, trees, rate), metrics)
            taken = (terms["h"] > 0) & (row_bucket(flat["rid"], number) < int(subsample * 10000))
            cells, at = np.unique(bins[:, use], axis=0, return_inverse=True)
            for c in ("g", "h"):
                terms[c] = np.where(taken, terms[c], 0.0)
            yield pa.RecordBatch.from_pydict({
                **{f"_b{i}": pa.array(cells[:, k].astype(np.int32)) for k, i in enumerate(use)},
                **{c: pa.array(np.bincount(at.ravel(), terms[c], len(cells))) for c in names}})

    keys = [f"_b{i}" for i in use]
    rows = state.mapInArrow(sums, ", ".join([f"{c} int" for c in keys] + [f"{c} double" for c in names]))
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names]).toPandas().sort_values(keys, kind="stable")


def moved_state(state: DataFrame, n_cols: int, trees: list[list], rate: float) -> DataFrame:
    """The packed groups with their scores after ``trees``."""
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, flat, bins = packed_groups(batch, n_cols)
            lists = batch.column("rid")
            offsets = pa.array(np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32))
            score = pa.ListArray.from_arrays(offsets, pa.array(moved(flat["score"], bins, trees, rate)))
            yield batch.set_column(batch.schema.get_field_index("score"), "score", score)

    return state.mapInArrow(move, state.schema)


def _kept(state: DataFrame, last: str | None = None) -> tuple[DataFrame, str]:
    """The state as a table of its own, and where; it takes the place of the ``last`` one."""
    spark = state.sparkSession
    path = shared_dir(spark, "ranker-state")
    state.write.parquet(path)
    if last is not None:
        dropped(spark, last)
    return spark.read.schema(state.schema).parquet(path), path


def train_pairwise(features: DataFrame, n_trees: int = N_TREES, learning_rate: float = LEARNING_RATE,
                   max_depth: int = MAX_DEPTH, subsample: float = SUBSAMPLE, colsample: float = COLSAMPLE,
                   seed: int = 42, feature_cols=FEATURE_COLUMNS, track_accuracy: bool = False) -> PairwiseRanker:
    """Boost ``n_trees`` trees on (userId, features..., label) rows, at most
    ``MAX_GROUP`` of a user (the feature step keeps 20); more are an error."""
    cols = list(feature_cols)
    rng = random.Random(seed)
    # Rows are sampled by what they hold, so trees do not depend on files or
    # partitions; equal rows of a user are told apart by their number.
    held = ["userId", *[c for c in ("movieId",) if c in features.columns], *cols, "label"]
    copies = Window.partitionBy(*held).orderBy(F.lit(1))
    base = (features.select(*held).withColumn("_copy", F.row_number().over(copies))
            .select("userId", *[F.col(c).cast("double").alias(c) for c in cols],
                    F.col("label").cast("double").alias("label"), F.xxhash64(*held, "_copy").alias("rid")))
    state = base
    largest = state.groupBy("userId").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > MAX_GROUP:
        raise ValueError(f"a user has {largest} rows; keep the best {MAX_GROUP} or fewer")
    edges = bin_edges(state, cols)
    for i, cuts in enumerate(edges):
        value = F.col(cols[i])
        over = F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c < value)
        # A missing value lies beyond all cuts, as in scoring.
        state = state.withColumn(f"_b{i}", F.when(F.col(cols[i]).isNull(), len(cuts)).otherwise(F.size(over)))
    # One row a user from here on, its rows in the order of their hashes.
    packed = ["rid", "label", *[f"_b{i}" for i in range(len(cols))]]
    groups = state.groupBy("userId").agg(F.array_sort(F.collect_list(F.struct(*packed))).alias("rows"))
    with short_shuffles(features.sparkSession):
        state, path = _kept(groups.select(*[F.col(f"rows.{c}").alias(c) for c in packed],
                                          F.transform("rows", lambda x: F.lit(0.0)).alias("score")))
    pending: list[list] = []  # trees that the written scores do not hold yet
    trees: list[tuple[list[str], Tree]] = []
    history: list[dict] = []
    n_cols = max(1, int(round(colsample * len(cols))))
    if (BINS + 1) ** n_cols > MAX_CELLS:
        raise ValueError(f"{n_cols} features a tree make too many cells; lower colsample")
    for r in range(n_trees):
        use = sorted(rng.sample(range(len(cols)), n_cols))
        use_cols = [cols[i] for i in use]
        # One aggregation gives the cells of this round and, with tracking,
        # the metrics of the model so far (r trees).
        cells = cell_sums(state, len(cols), use, pending, learning_rate, seed + r, subsample, track_accuracy)
        if track_accuracy and r > 0:
            history.append({"round": r, **_ratios(*(float(cells[c].sum()) for c in ("_pn", "_pok", "_ploss")))})
        sums = [np.round(cells[c].fillna(0.0).to_numpy(dtype=float), 9) for c in ("g", "h")]
        tree = grow_tree(cells[[f"_b{i}" for i in use]].to_numpy(dtype=np.int64), *sums, [edges[i] for i in use], max_depth)
        trees.append((use_cols, tree))
        pending.append(binned(tree, use, edges))
        if (r + 1) % CHECKPOINT_EVERY == 0:
            state, path, pending = *_kept(moved_state(state, len(cols), pending, learning_rate), path), []
    if track_accuracy and n_trees > 0:
        last = cell_sums(state, len(cols), [0], pending, learning_rate, 0, 0.0, True)
        history.append({"round": n_trees, **_ratios(*(float(last[c].sum()) for c in ("_pn", "_pok", "_ploss")))})
    dropped(features.sparkSession, path)
    return PairwiseRanker(cols, trees, learning_rate, history)


def score_rows(df: DataFrame, ranker: PairwiseRanker, intent_weight=1.0) -> DataFrame:
    """Adds ``score`` = sanitized model score x clamped intent weight.

    ``intent_weight`` may be a number or a column name. Missing feature
    columns raise ValueError (like the reference); an empty input gives an
    empty output.
    """
    missing = [c for c in ranker.feature_cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required feature column(s): {missing}")
    w = clamp_weight(F.col(intent_weight) if isinstance(intent_weight, str) else F.lit(float(intent_weight)))
    return df.withColumn("score", sanitize(ranker.raw_score()) * w)
