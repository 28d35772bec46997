"""Compression of vectors to short codes, assigned by equal-average search.

Vectors become integers (``floor(SCALE * x)``) and are cut into equal
consecutive parts. Each part position has a codebook of a few entries, refined
by a fixed number of rounds (assign every part to its nearest entry, replace
each entry by the floored mean of its parts).

Nearest entry: the entries of a codebook are sorted by the sum of their
components. A part starts at the sums next to its own and looks outward, the
nearer side first. By the inequality of Cauchy and Schwarz the squared distance
is at least (gap of the sums) squared / dimension, so a part stops as soon as
that bound strictly exceeds the best distance so far (entries at the bound may
tie and are looked at; ties go to the lower index). All parts of a batch that
still search take a step together; all numbers are integers, results exact.

Scale: vectors are read where they lie, once a round; nothing is cached and no
vector is shuffled. A task sends one partial sum per codebook component
(parts x entries x dimension numbers), summed on Spark by component; the driver
gets that many sums, whatever the number of vectors, and the codebooks travel
with the next round's tasks. Sums per label are aggregated before they shuffle
and joined back, so a hot label is split like any join.

Defined results: rows whose vector is null or holds null or non-finite
components are dropped. Repeated rows count each. Rows of a null id are coded
like others, but give no first entry. Ties of equal ids are ordered by their
integers. With fewer vectors than entries there are as many entries as
vectors. The dimension is that of the first vector by id; a vector of another
dimension stays, with a null code and error. A dimension that is no multiple
of the number of parts and components of 2**15 or more in size are errors
(squares would not fit 64 bits). An empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values ------------------------------------------------------------
SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
MOST = 1 << 15  # components must be smaller
# -----------------------------------------------------------------------------


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, vector, label) of the rows that are kept."""
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.select(F.col(id_col).alias("id"), vector.alias("vector"), F.col(label_col).alias("label")).filter(
        vector.isNotNull() & finite)


def integers(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    if len(values) and np.abs(values).max() >= MOST:
        raise ValueError(f"a component is {MOST} or more in size")
    return np.floor(SCALE * values).astype(np.int64)


def first_vectors(kept: DataFrame, entries: int) -> np.ndarray:
    """Integer vectors of the smallest ids: at most ``entries`` rows reach the driver."""
    size = F.size("vector")
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * SCALE))
    rows = kept.filter("id IS NOT NULL").orderBy("id", whole).limit(entries).select("vector", size.alias("n")).collect()
    if not rows:
        return np.zeros((0, 0), np.int64)
    found = [integers(np.array(r["vector"], np.float64)) for r in rows if r["n"] == rows[0]["n"]]
    return np.stack(found)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of each part (rows)."""
    n, dim = parts.shape
    sums = book.sum(axis=1)
    order = np.lexsort([np.arange(len(book)), sums])
    ranked, mine = sums[order], parts.sum(axis=1)
    right = np.searchsorted(ranked, mine)
    left = right - 1
    far = np.int64(1) << 62
    best, index = np.full(n, far), np.full(n, len(book), np.int64)
    active = np.arange(n)
    padded = np.concatenate([ranked, [0]])
    while len(active):
        lo, hi, s = left[active], right[active], mine[active]
        down = np.where(lo >= 0, s - padded[lo], far)
        up = np.where(hi < len(book), padded[hi] - s, far)
        below = down <= up
        gap = np.where(below, down, up)
        # Stop when nothing is left or the bound exceeds the best distance.
        known = best[active] < far
        small = np.where(gap < far, gap, 0)
        over = (gap == far) | (known & (small * small > np.where(known, best[active], 0) * dim))
        active, below, lo, hi = active[~over], below[~over], lo[~over], hi[~over]
        if not len(active):
            break
        entry = order[np.where(below, lo, hi)]
        gaps = parts[active] - book[entry]
        distance = np.einsum("ij,ij->i", gaps, gaps)
        better = (distance < best[active]) | ((distance == best[active]) & (entry < index[active]))
        best[active[better]], index[active[better]] = distance[better], entry[better]
        left[active[below]] -= 1
        right[active[~below]] += 1
    return index, best


def matrices(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Integer vectors of dimension ``dim`` of a batch, and their rows."""
    lists = batch.column("vector")
    at = np.flatnonzero(pc.list_value_length(lists).to_numpy(zero_copy_only=False) == dim)
    values = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
    return integers(values).reshape(len(at), dim), at


def assigned(matrix: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry index (rows x parts) and squared distances of each part."""
    parts, _, width = books.shape
    found = [nearest(matrix[:, p * width:(p + 1) * width], books[p]) for p in range(parts)]
    return np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def refined(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floored mean of its parts."""
    parts, entries, width = books.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Per part and entry: the number of parts, then their component sums.
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            matrix, _ = matrices(batch, parts * width)
            if not len(matrix):
                continue
            index, _ = assigned(matrix, books)
            for p in range(parts):
                order = np.argsort(index[:, p], kind="stable")
                there, begin = np.unique(index[order, p], return_index=True)
                total[p, there, 0] += np.diff(np.append(begin, len(order)))
                total[p, there, 1:] += np.add.reduceat(matrix[order, p * width:(p + 1) * width], begin, axis=0)
        flat = total.reshape(-1)
        slots = np.flatnonzero(flat)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(slots.astype(np.int32)), "total": pa.array(flat[slots])})

    sums = kept.select("vector").mapInArrow(partial, "slot int, total long").groupBy("slot").agg(F.sum("total").alias("total"))
    flat = np.zeros(parts * entries * (width + 1), np.int64)
    for slot, total in sums.collect():  # bounded by the size of the codebooks
        flat[slot] = total
    found = flat.reshape(parts, entries, width + 1)
    counts = found[:, :, :1]
    return np.where(counts > 0, found[:, :, 1:] // np.maximum(counts, 1), books)


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x width) of the kept rows (see ``usable``)."""
    first = first_vectors(kept, entries)
    if not len(first):
        return np.zeros((parts, 0, 0), np.int64)
    if first.shape[1] % parts:
        raise ValueError(f"vectors of {first.shape[1]} components cannot be cut into {parts} equal parts")
    books = first.reshape(len(first), parts, -1).swapaxes(0, 1).copy()
    for _ in range(rounds):
        books = refined(kept, books)
    return books


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code (two hex digits a part; four from 257 entries on) and error of each row."""
    parts, entries, width = books.shape
    digits = 2 if entries <= 256 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            if entries:
                matrix, at = matrices(batch, parts * width)
                index, distance = assigned(matrix, books)
                named = np.array([f"{e:0{digits}x}" for e in range(entries)], object)
                code[at] = ["".join(row) for row in named[index].tolist()]
                error[at] = distance.sum(axis=1).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())],
                ["id", "label", "code", "error"])

    schema = T.StructType([kept.schema["id"], kept.schema["label"], T.StructField("code", T.StringType()),
                           T.StructField("error", T.LongType())])
    return kept.select("id", "label", "vector").mapInArrow(run, schema)


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def digest(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """The contract's columns."""
    from marquee.llm.frames import written

    kept = usable(rows, id_col, vector_col, label_col)
    books = fit(kept)
    coded = written(encode(kept, books), "codes")
    labels = coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    return coded.join(labels, F.col("label").eqNullSafe(F.col("l"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same in SQL: plain least distances, one common table per round."""
    value = "CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)"
    out = [f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: {value}) AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, vec_id, label, k, w[k * (len(w) // 8) + 1 : (k + 1) * (len(w) // 8)] AS x
                   FROM v, range(8) AS t(k)),
b0 AS MATERIALIZED (SELECT k, r - 1 AS e, x AS y FROM p WHERE r <= 16)"""]
    nearest_ = """SELECT r, k, arg_min(e, d * 16 + e) AS e, min(d) AS d FROM (
    SELECT p.r, p.k, b.e, list_sum(list_transform(list_zip(p.x, b.y), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS d
    FROM p JOIN {book} b USING (k)) GROUP BY 1, 2"""
    for i in range(ROUNDS):
        out.append(f"""a{i} AS MATERIALIZED ({nearest_.format(book=f'b{i}')}),
m{i} AS (SELECT k, e, j, sum(x[j]) AS s, count(*) AS c FROM a{i} JOIN p USING (r, k), range(1, 9) AS t(j) WHERE j <= len(x) GROUP BY 1, 2, 3),
b{i + 1} AS MATERIALIZED (SELECT b.k, b.e, coalesce(l.y, b.y) AS y FROM b{i} b LEFT JOIN (
  SELECT k, e, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY j) AS y FROM m{i} GROUP BY 1, 2) l USING (k, e))""")
    out.append(f"""f AS MATERIALIZED ({nearest_.format(book=f'b{ROUNDS}')}),
codes AS (SELECT r, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY k) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY 1),
book AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY k, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN codes USING (r), book""")
    return ",\n".join(out)


ORACLE = _oracle()
