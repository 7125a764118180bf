"""Labelled text sets: one layout (text, label) from several column sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def read_labelled_csv(spark: SparkSession, path: str, on_unknown: str = "keep") -> DataFrame:
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return normalize_labelled(raw, on_unknown)


def normalize_labelled(df: DataFrame, on_unknown: str = "keep") -> DataFrame:
    """text, label from {text,label}, {abstract,label} or {text,generated}.

    {text,label} is taken as it is. Otherwise 0/1 become human/ai, and labels
    that are neither stay as they are (``keep``) or lose their row (``drop``,
    which also admits {text,generated}). Rows with a null go.
    """
    cols = set(df.columns)
    if {"text", "label"} <= cols:
        out = df.select("text", "label")
    elif on_unknown == "drop" and {"text", "generated"} <= cols:
        out = df.select("text", decode_label("generated", keep=False))
    elif {"abstract", "label"} <= cols:
        out = df.select(F.col("abstract").alias("text"), decode_label("label", keep=on_unknown == "keep"))
    else:
        raise ValueError("need columns text,label or abstract,label (or text,generated)")
    return out.dropna(subset=["text", "label"])


def decode_label(column: str, keep: bool):
    # Numbers may arrive as 0, 0.0 or "0".
    num = F.expr(f"try_cast(`{column}` AS double)")
    known = F.when(num == 0, "human").when(num == 1, "ai")
    return (F.coalesce(known, F.col(column).cast("string")) if keep else known).alias("label")


def encode_label(label):
    return F.when(label == "human", 0).when(label == "ai", 1).cast("int")


def labelled_turns(turns: DataFrame) -> DataFrame:
    """Conversation turns as a labelled set: assistant = ai, user = human; others go."""
    label = F.when(F.col("role") == "assistant", "ai").when(F.col("role") == "user", "human")
    return turns.select("conv_id", "turn", "text", label.alias("label")).dropna(subset=["text", "label"])


def row_ids(df: DataFrame, *keys: str) -> DataFrame:
    """Add row_id, a readable key made of ``keys``."""
    return df.withColumn("row_id", F.concat_ws(":", *[F.col(k).cast("string") for k in keys]))
