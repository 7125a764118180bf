"""Pieces shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copytrace.session import materialize, tune
from copytrace.sources.tables import read_table

# White space of the word and line contracts: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings: those of the text jobs, and Arrow batches bounded by bytes (texts differ much in length)."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    return spark


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal an input of fewer splits than cores by ``keys``; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(prepare(spark), folder, "documents")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(prepare(spark), folder, "embeddings")


def text_of(column: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def rank_by(df: DataFrame, *order: Column, name: str = "ranked") -> DataFrame:
    """``df`` with ``rank``: 1, 2, 3... in this order, however many rows are equal in it."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("at"))
    placed = materialize(placed, name)
    # The number of a row: the partition in the upper bits, the place in the lower 33.
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = placed.join(F.broadcast(starts), part == F.col("part"))
    return ranked.select(*df.columns, (F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("rank"))
