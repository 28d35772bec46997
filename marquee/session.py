"""Session helpers: a local session for tests/bench and shared folders.

Jobs never write to machine-local folders on a cluster: scratch output and
lineage cuts go below the folder the cluster names in ``spark.checkpoint.dir``.
Only when that setting is absent (local tests) do we make one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "marquee") -> SparkSession:
    """Session for tests and the bench (the cluster provides its own)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Small local data: keep AQE from merging every shuffle into one
        # task (no effect once partitions are large, as on a cluster).
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("MARQUEE_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; made only when unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        # Local runs only: on a cluster executors do not share the driver's folders.
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="marquee-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss; never localCheckpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# A query's shuffle files go when the query has ended, not when its plan is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_short_lock = threading.Lock()
_short: dict = {}


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, what a query shuffled is deleted as soon as the query ends: for steps that write
    tables and run no DataFrame twice. Threads may overlap; the session's own value
    is back when the last has left."""
    key = spark.sparkContext.applicationId
    with _short_lock:
        inside, before = _short.get(key, (0, None))
        if not inside:
            before = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _short[key] = inside + 1, before
    try:
        yield
    finally:
        with _short_lock:
            inside, before = _short[key]
            _short[key] = inside - 1, before
            if inside == 1:
                spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
