"""Packed rows, and plans in which each part of a table meets a whole second one.

Factors are rows of bytes: many ids and their vectors in one row, so a scan copies
them as they are. ``each_with_all`` gives every part of a table, in one task, all rows
of a second table straight from its files. Nothing is shuffled for that: what
lies on disk is the tables themselves, not a copy per part.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A scan holds rows of at most one row group; packed rows are large.
ROW_GROUP = 4 << 20
FACTORS = "ids binary, factors binary"
# Ids of a packed row.
PACK_IDS = 4096


def written(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """``df`` as a table of small row groups below ``path``, in a folder per value of ``by``."""
    out = df.write.option("parquet.block.size", str(ROW_GROUP))
    (out.partitionBy(by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table that this library wrote between two steps."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def each_with_all(own: DataFrame, shared: DataFrame, n: int) -> DataFrame:
    """Partition i holds the rows of ``own`` (``written`` by ``part``) of part i, then all
    rows of ``shared``; columns that a side lacks are null."""
    parts = [own.filter(F.col("part") == i).drop("part").unionByName(shared, allowMissingColumns=True).coalesce(1) for i in range(n)]
    # No part is -1. Without that empty scan Spark would take a union of single
    # partitions for one that is a single partition itself.
    parts.append(own.filter(F.col("part") == -1).drop("part").unionByName(shared.filter("false"), allowMissingColumns=True))
    while len(parts) > 1:  # a shallow tree of unions
        parts = [reduce(DataFrame.unionByName, parts[i:i + 8]) for i in range(0, len(parts), 8)]
    return parts[0]


def ints(cell: pa.Scalar, dtype: type = np.int32) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), dtype) if cell.is_valid else np.zeros(0, dtype)


def packed(ids: np.ndarray, factors: np.ndarray) -> pa.RecordBatch:
    """Ids and their vectors as packed rows."""
    at = range(0, len(ids), PACK_IDS)
    return pa.RecordBatch.from_pydict({
        "ids": pa.array([ids[i:i + PACK_IDS].astype(np.int32).tobytes() for i in at], pa.binary()),
        "factors": pa.array([factors[i:i + PACK_IDS].astype(np.float32).tobytes() for i in at], pa.binary())})


def vectors(batch: pa.RecordBatch, id_column: str, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a batch of (id, array) rows."""
    ids = batch.column(id_column).to_numpy(zero_copy_only=False)
    return ids, batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
