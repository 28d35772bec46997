"""Column profiles that merge.

One pass over a table gives one state row per column: rows, nulls, least and
greatest value, and a sketch of the distinct values. States of parts of a
table (files, days, partitions) merge into the state of the whole, so a
growing table is profiled by its new part alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values ------------------------------------------------------------
SKETCH_BITS = 12  # 2**12 registers: a relative standard error of about 1.6 %
# -----------------------------------------------------------------------------


def column_states(df: DataFrame, name: str) -> DataFrame:
    """(table_name, column_name, n_rows, n_null, low, high, low_text,
    high_text, sketch) per column, from one aggregation without a shuffle of
    rows. Numbers (and times, in seconds) are bounded as doubles, texts as texts."""
    aggregates, columns = [F.count(F.lit(1)).alias("n")], []
    for i, field in enumerate(df.schema.fields):
        c = F.col(f"`{field.name}`")
        number = isinstance(field.dataType, T.NumericType)
        time = isinstance(field.dataType, (T.TimestampType, T.DateType))
        value = c.cast("double") if number else c.cast("timestamp").cast("double") if time else F.lit(None).cast("double")
        text = c if isinstance(field.dataType, T.StringType) else F.lit(None).cast("string")
        aggregates += [F.count_if(c.isNull()).alias(f"z{i}"), F.min(value).alias(f"a{i}"), F.max(value).alias(f"b{i}"),
                       F.min(text).alias(f"c{i}"), F.max(text).alias(f"d{i}"),
                       F.hll_sketch_agg(_as_text(c, field.dataType), F.lit(SKETCH_BITS)).alias(f"s{i}")]
        columns.append(F.struct(F.lit(field.name).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"z{i}").alias("n_null"),
                                F.col(f"a{i}").alias("low"), F.col(f"b{i}").alias("high"), F.col(f"c{i}").alias("low_text"),
                                F.col(f"d{i}").alias("high_text"), F.col(f"s{i}").alias("sketch")))
    return df.agg(*aggregates).select(F.explode(F.array(*columns)).alias("s")).select(F.lit(name).alias("table_name"), "s.*")


def _as_text(column: F.Column, kind: T.DataType) -> F.Column:
    """Equal values have equal texts; nested values by their JSON."""
    return F.to_json(F.struct(column)) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else column.cast("string")


def merged_states(states: DataFrame) -> DataFrame:
    """States of several parts as states of the whole."""
    return states.groupBy("table_name", "column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("low_text").alias("low_text"), F.max("high_text").alias("high_text"), F.hll_union_agg("sketch").alias("sketch"))


def column_profile(states: DataFrame) -> DataFrame:
    """States with the sketch read: ``n_distinct``, an estimate."""
    return states.withColumn("n_distinct", F.hll_sketch_estimate("sketch")).drop("sketch")
