"""Metrics over labelled predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copytrace.functions.numeric import log_loss, round_even
from copytrace.functions.ranking import bucket_offsets


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(round_even(a / b, 4))


def binary_metrics(df: DataFrame, label: str = "label", predicted: str = "predicted", positive: str = "ai") -> DataFrame:
    """One row: n, accuracy, precision, recall, f1 of the positive class."""
    y, p = F.col(label) == positive, F.col(predicted) == positive
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(label) == F.col(predicted)).alias("right"),
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "n",
        _ratio(F.col("right"), F.col("n")).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def confusion_matrix(
    df: DataFrame, classes: Sequence[str] = ("ai", "human"), label: str = "label", predicted: str = "predicted"
) -> DataFrame:
    """Row per true class, column ``pred_<class>`` per predicted class."""
    cells = [F.count_if(F.col(predicted) == c).alias(f"pred_{c}") for c in classes]
    return df.filter(F.col(label).isin(*classes)).groupBy(label).agg(*cells)


def roc_auc(df: DataFrame, score: str, label: str = "label", positive: str = "ai", buckets: int = 64) -> DataFrame:
    """One row: exact area under the ROC curve, ties counting one half.

    Rows are merged per distinct score first. Distinct scores are cut into
    even ranges, whose totals give each range its offset, so that no task
    sorts more than one range.
    """
    y = F.col(label) == positive
    groups = df.groupBy(F.col(score).alias("s")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    steps = [i / buckets for i in range(1, buckets)]
    cuts = groups.agg(F.percentile_approx("s", steps, 10000).alias("c")).first()["c"] or []
    edges = sorted(set(cuts))
    bucket = F.size(F.filter(F.lit(edges).cast("array<double>"), lambda e: e < F.col("s"))) if edges else F.lit(0)
    groups = groups.withColumn("bucket", bucket)
    totals = groups.groupBy("bucket").agg(F.sum("neg").alias("n"))
    below = bucket_offsets(totals, [F.lit(0)], "n", "below").select("bucket", "below")
    inner = Window.partitionBy("bucket").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = groups.withColumn("inside", F.coalesce(F.sum("neg").over(inner), F.lit(0))).join(F.broadcast(below), "bucket")
    wins = F.col("pos") * (F.col("below") + F.col("inside") + F.col("neg") / F.lit(2.0))
    sums = ranked.agg(F.sum(wins).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    pairs = F.col("p").cast("double") * F.col("q")
    return sums.select(F.when(pairs > 0, round_even(F.col("u") / pairs, 4)).alias("roc_auc"))


def logit_predictions(df: DataFrame, logits: str = "logits") -> DataFrame:
    """Add predicted_index, the first position of the largest logit."""
    at = F.array_position(logits, F.array_max(logits)) - 1
    return df.withColumn("predicted_index", at.cast("int"))


def logit_metrics(df: DataFrame, logits: str = "logits", true_index: str = "true_index", positive: int = 1) -> DataFrame:
    """One row: n, accuracy, precision, recall, f1 of the argmax prediction."""
    return binary_metrics(logit_predictions(df, logits), true_index, "predicted_index", positive)


def nll(df: DataFrame, temperature: float = 1.0, logits: str = "logits", true_index: str = "true_index") -> DataFrame:
    """One row: mean negative log-likelihood at ``temperature``."""
    return df.agg(F.avg(log_loss(F.col(logits), F.col(true_index), temperature)).alias("nll"))


def nll_curve(
    df: DataFrame, temperatures: Sequence[float], logits: str = "logits", true_index: str = "true_index"
) -> DataFrame:
    """temperature, nll for a list of temperatures, in one pass over the data."""
    means = [F.avg(log_loss(F.col(logits), F.col(true_index), t)).alias(f"t{i}") for i, t in enumerate(temperatures)]
    row = df.agg(*means)
    points = [F.struct(F.lit(float(t)).alias("temperature"), F.col(f"t{i}").alias("nll")) for i, t in enumerate(temperatures)]
    return row.select(F.inline(F.array(*points)))
