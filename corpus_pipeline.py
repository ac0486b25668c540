"""A training-corpus pipeline over ``documents``; each stage is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.llm import decontam, neardup, packing, quality, secretscan
from vigilframe.llm.common import table
from vigilframe.operators.loops import shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose quality score is below the threshold."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.with_score(docs, model, score="pipeline_score").where(F.col("pipeline_score") >= quality.THRESHOLD).select(*COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: one with the group's smallest id."""
    return neardup.kept_rows(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects contaminated documents; the others stay whole."""
    return decontam.judged(decontam.find(docs, table(spark, sf_dir, "benchmark"), carry=COLUMNS[2:])).where("NOT contaminated").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret in the text and counts the characters anew; every document stays."""
    found = secretscan.with_spans(docs, spans="pipeline_spans")
    text = F.when(F.size("pipeline_spans") > 0, secretscan.masked("text", "pipeline_spans")).otherwise(F.col("text"))
    n_chars = F.when(F.size("pipeline_spans") > 0, F.length("pipeline_text")).otherwise(F.col("n_chars"))
    return found.withColumn("pipeline_text", text).select("doc_id", F.col("pipeline_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", classify), ("near-duplicates", dedup), ("benchmark decontamination", decontaminate), ("secret scan", redact), ("packing", pack)]

ORACLE_SQL = None  # compression, minhash and tokenizers are not SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
