"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use every core on an input that arrives in too few splits.

    Text work is heavy per row, so a small file read as one split would run on
    one core. Inputs with enough splits stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def corpus_table(spark: SparkSession, folder: str) -> DataFrame:
    """documents as a reference corpus: doc_id, text."""
    return spread(read_table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


def query_table(spark: SparkSession, folder: str) -> DataFrame:
    """benchmark passages as query documents: query_id, text."""
    df = read_table(spark, folder, "benchmark")
    return spread(df.selectExpr("item_id AS query_id", "text"), "query_id")


def turn_table(spark: SparkSession, folder: str) -> DataFrame:
    """conversation turns: conv_id, turn, role, text."""
    return spread(read_table(spark, folder, "conversations"), "conv_id", "turn")
