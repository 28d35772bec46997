"""Registered queries: each applies one operator, with its production
parameters, to the whole of its table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import (
    conversation_repair,
    decontaminate,
    jaccard_join,
    license_scan,
    minhash,
    pii,
    quality_classifier,
    quality_rules,
    sentencepiece_codec,
    substring_dedup,
    token_store,
    toxicity,
    vector_codes,
)
from marquee.llm.frames import read_table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_classifier.classify(docs, quality_classifier.fit(docs, read_table(spark, sf_dir, "labels")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: they are laid out as files of a tree
    source/language/thousands of ids. A document whose first line names its
    licence stands for the licence file of its directory."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    found = license_scan.scan(docs.withColumn("path", path), "path", keep_columns=("doc_id",))
    return license_scan.inherit(found, F.col("first")).select("doc_id", "path", "own", "score", "licence", "origin")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.apply_rules(docs, read_table(spark, sf_dir, "labels"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes, decodes from the ids and compares."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, keep_columns=("doc_id", "text")))
    return back.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
                       F.xxhash64("ids").alias("ids_hash"), F.col("decoded").eqNullSafe(F.col("text")).alias("exact"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.digest(jaccard_join.near_duplicates(docs))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_store.load(token_store.store(docs)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.detect(docs))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.digest(minhash.near_duplicates(docs))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(read_table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages the conversations as the contract says and repairs them."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.digest(conversation_repair.damaged(rows))


QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_substring_dedup, op3_toxicity, op4_quality_classifier,
    op5_license_scan, op6_quality_rules, op7_sentencepiece,
    op8_jaccard_join, op9_token_store, op10_pii, op11_minhash_dedup,
    op12_vector_codes, op13_conversation_repair)}
ORACLES: dict[str, str] = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op2_substring_dedup": substring_dedup.ORACLE,
    "op8_jaccard_join": jaccard_join.ORACLE,
    "op11_minhash_dedup": minhash.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_conversation_repair": conversation_repair.ORACLE,
}
