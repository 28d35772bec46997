"""Small helpers shared by the operators: Arrow batches, words and hashes.

Text reaches Python only as Arrow batches, cut into slices of a few megabytes,
so the memory of a task does not grow with the number or order of its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared checkpoint folder and read back:
    a lineage cut that survives lost executors."""
    from marquee.session import shared_dir

    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``max_bytes`` of text (one longer
    text is a slice by itself); null texts become empty ones."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        k = batch.schema.get_field_index(text)
        filled = pc.fill_null(batch.column(k).cast(pa.large_string()), "")
        batch = batch.set_column(k, text, filled)
        ends = np.cumsum(pc.binary_length(filled).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch],
               schema: T.StructType | str, text: str = "text", max_bytes: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over text slices; ``fn`` makes one batch of each slice."""

    def run(batches):
        for part in slices(batches, text, max_bytes):
            out = fn(part)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


class Words:
    """Words of a slice, split at the six ASCII white-space characters.

    ``codes`` numbers the words of all texts in a row, ``values`` has the
    distinct words, ``starts`` the first word of each text (and the end).
    """

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(texts)
        offsets = split.offsets.to_numpy()
        flat = split.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
        offsets = (offsets - offsets[0]).astype(np.int64)
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        self.values = coded.dictionary
        sizes = pc.binary_length(self.values).to_numpy(zero_copy_only=False)
        empty = np.flatnonzero(sizes == 0)
        if len(empty):
            full = codes != empty[0]
            before = np.concatenate([[0], np.cumsum(full)])
            offsets, codes = before[offsets], codes[full]
        self.codes, self.starts = codes, offsets
        self.counts = np.diff(offsets)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, in text order."""
        return word_hashes(self.values)[self.codes] if len(self.codes) else np.zeros(0, np.uint64)

    def sums(self, per_value: np.ndarray) -> np.ndarray:
        """Sum over each text of a number that belongs to the distinct word."""
        total = np.concatenate([[0], np.cumsum(per_value[self.codes])])
        return total[self.starts[1:]] - total[self.starts[:-1]]

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def word_hashes(values: pa.Array) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    binary = values.cast(pa.large_binary()) if not pa.types.is_large_binary(values.type) else values
    return np.fromiter((digest(x) for x in binary.to_pylist()), np.uint64, len(values))


def rolling(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hash (mod 2**64) of every ``size`` hashes in a row, finished
    by a mixing step so that all bits are usable. O(n log size)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        # out covers `done` items; power covers 2**bit items: binary method.
        out, done = np.zeros(len(hashes), np.uint64), 0
        power, length, factor = hashes.copy(), 1, np.uint64(base)
        out_len = len(hashes)
        left = size
        while left:
            if left & 1:
                m = min(out_len, len(power) - done) if done else len(power)
                out = (out[:m] * factor + power[done:done + m]) if done else power[:m].copy()
                out_len, done = m, done + length
            left >>= 1
            if left:
                m = len(power) - length
                power = power[:m] * factor + power[length:length + m]
                length, factor = length * 2, factor * factor
        return mix(out[:n])


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing step of a 64-bit hash (a bijection)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def training_rows(labels: DataFrame, label: str, limit: int | None, id_col: str = "doc_id",
                  held_out: bool = True) -> DataFrame:
    """A bounded, repeatable sample of labelled ids: the ``limit`` rows whose
    id hashes lowest (None: all rows). Held-out ids (crc32 of the id as text, mod 5 = 0) are
    left out when ``held_out``; null ids and labels never count; an id with
    two labels counts once, with the greater."""
    rows = labels.select(F.col(id_col).alias(id_col), F.col(label).cast("int").alias("label")).dropna()
    if held_out:
        rows = rows.filter(~is_held_out(F.col(id_col)))
    rows = rows.groupBy(id_col).agg(F.max("label").alias("label"))
    return rows if limit is None else rows.orderBy(F.xxhash64(id_col), F.col(id_col)).limit(limit)


def is_held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))
