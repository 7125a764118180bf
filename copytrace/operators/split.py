"""Seeded permutation chunks and exact stratified splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copytrace.functions.ranking import shuffled_rank


def shuffled_chunk(df: DataFrame, keys: Sequence[str], chunk_id: int, size: int, seed: int = 42) -> DataFrame:
    """Rows [chunk_id * size, chunk_id * size + size) of a seeded permutation, with ``position`` (0-based)."""
    ranked = shuffled_rank(df, keys, seed).withColumn("position", F.col("rank") - 1).drop("rank")
    first = chunk_id * size
    return ranked.filter((F.col("position") >= first) & (F.col("position") < first + size))


def label_quota(df: DataFrame, label: str, test_size: float) -> DataFrame:
    """label, quota: test rows per label, ceil(n * test_size) in total.

    Each label gets the whole part of its share; the rows left over go to the
    largest remainders. The table has one row per label.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("n").over(everything)
    target = F.ceil(F.round(total * F.lit(test_size), 9))
    shares = counts.withColumn("target", target).withColumn("share", F.col("n") * F.col("target") / total)
    shares = shares.withColumn("base", F.floor("share"))
    rest = F.col("target") - F.sum("base").over(everything)
    order = Window.partitionBy(F.lit(0)).orderBy((F.col("share") - F.col("base")).desc(), label)
    extra = F.when(F.row_number().over(order) <= rest, 1).otherwise(0)
    return shares.select(label, (F.col("base") + extra).alias("quota"))


def stratified_split(
    df: DataFrame, keys: Sequence[str], label: str = "label", test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """``df`` plus ``split`` in {train, test}: exact sizes overall and per label."""
    ranked = shuffled_rank(df, keys, seed, by=[label])
    quota = label_quota(df, label, test_size).withColumnRenamed(label, "_label")
    joined = ranked.join(quota, F.col(label).eqNullSafe(F.col("_label")))
    split = F.when(F.col("rank") <= F.col("quota"), "test").otherwise("train")
    return joined.select(*df.columns, split.alias("split"))
