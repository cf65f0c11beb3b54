"""Queries of the training-data operators on texts (problems 3, 5, 6, 7, 8 and 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import contamination, handwritten, packing, pairs, repetition, syntax
from arbora.plans.registry import Registry
from arbora.sources.tables import table

R = Registry()


@R.add("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.found(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "documents"))


@R.add("p3_pairs")
def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pairs(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "documents"))


@R.add("p3_steps")
def p3_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documented functions templates, syntax and lists refuse, and how many say something."""
    return pairs.steps(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "documents"))


@R.add("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "files"))


@R.add("p5_faults")
def p5_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every flagged file with its edit cost, the kind of fault and the line of the first edit."""
    return syntax.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "files")).filter("cost > 0")


@R.add("p5_rates")
def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "files"))


@R.add("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.found(table(spark, sf_dir, "files"), table(spark, sf_dir, "documents"), table(spark, sf_dir, "library_hashes"))


@R.add("p6_judged")
def p6_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.judged_files(table(spark, sf_dir, "files"), table(spark, sf_dir, "documents"), table(spark, sf_dir, "library_hashes"))


@R.add("p7_pack")
def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@R.add("p7_fill")
def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(packing.pack_documents(table(spark, sf_dir, "documents")))


@R.add("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@R.add("p8_leaks")
def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per test item: how many documents hold it and how much of it."""
    pairs = contamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_words").alias("most_words"))


@R.add("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.found(table(spark, sf_dir, "documents"))


@R.add("p9_repetition")
def p9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents")).select(
        "doc_id", "host", "n_words", "share", "pair_share", "line_share", "ratio", "failed", "failure_rate", "host_fails", "repetitive")
