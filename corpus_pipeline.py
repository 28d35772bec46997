"""A training corpus from the documents table, stage by stage.

Each stage applies one operator to what its predecessor kept and is written as
Parquet below the shared checkpoint folder; the next stage reads that.
Rows of a null id are kept like others; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import decontaminate, jaccard_join, pii, quality_rules, sentencepiece_codec
from marquee.llm.frames import read_table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality_rules.apply_rules(docs, read_table(spark, sf_dir, "labels"), keep_columns=COLUMNS)
    return judged.filter("kept").selectExpr(*[f"`_{c}` AS `{c}`" for c in COLUMNS])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the
    smallest id; texts without words are no group and stay."""
    found = jaccard_join.near_duplicates(docs)
    stays = found.filter("doc_id <=> component_id").select(F.col("doc_id").alias("id"), "k", "n_shingles").distinct()
    keyed = docs.withColumn("k_", jaccard_join.key_of("text"))
    kept = keyed.join(stays, (keyed["k_"] == stays["k"]) & keyed["doc_id"].eqNullSafe(stays["id"]))
    # A repeated row is a copy of itself.
    once = kept.filter("n_shingles > 0").dropDuplicates(["k_", "doc_id"])
    return once.select(*COLUMNS).unionByName(kept.filter("n_shingles = 0").select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    keyed = docs.withColumn("key_", F.xxhash64("text"))
    found = decontaminate.decontaminate(keyed, read_table(spark, sf_dir, "benchmark"), keep_columns=("key_",))
    dirty = found.filter("contaminated").select(F.col("doc_id").alias("id"), F.col("_key_").alias("k")).distinct()
    clean = keyed.join(dirty, (keyed["key_"] == dirty["k"]) & keyed["doc_id"].eqNullSafe(dirty["id"]), "left_anti")
    return clean.select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    found = pii.detect(docs, with_text=True, keep_columns=COLUMNS[2:])
    return found.selectExpr("doc_id", "redacted AS text", "_lang AS lang", "_source AS source",
                            "CAST(length(redacted) AS BIGINT) AS n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document; only texts that decode exactly count as such."""
    encoded = sentencepiece_codec.encode(docs, keep_columns=("doc_id", "text"))
    back = sentencepiece_codec.decode(encoded)
    return back.selectExpr("doc_id", "ids", "CAST(coalesce(size(ids), 0) AS BIGINT) AS n_tokens", "decoded <=> text AS exact")


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", decontaminated),
          ("personal data", private), ("tokens", tokens)]
#: The forest and the tokenizer are not expressible in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
