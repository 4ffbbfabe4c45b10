"""The corpus pipeline: stages (name, function) that each take (spark, docs, sf_dir) and return a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import decontam, langid, lines, packing, simhash
from tallyspark.llm.shared import parked


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the known languages go; the others' lang is the language they are in. Prototypes are fitted on the stage's own input."""
    return langid.keep_identified(docs, langid.prototypes(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates, those of one token included, stay in their first document alone."""
    return lines.line_dedup(docs, min_tokens=1).drop("dropped_lines")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document gets its place in a window of tokens."""
    return packing.pack(packing.token_lengths(docs))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packed),
]

#: Templates, fingerprints and subset sums are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents in turn, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = parked(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
