"""Temperature scaling of class logits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copytrace.functions.numeric import log_loss, scaled_exponentials, vector_sum

# Bounds of the temperature.
LOW, HIGH = 0.05, 10.0


def _slope(logits: Column, true_index: Column, inverse: float) -> Column:
    """Derivative of one row's loss by b = 1/T: expected logit minus true logit."""
    e = scaled_exponentials(logits, 1.0 / inverse)
    weighted = F.aggregate(F.zip_with(e, logits, lambda p, z: p * z), F.lit(0.0), lambda acc, x: acc + x)
    return weighted / vector_sum(e) - F.element_at(logits, true_index.cast("int") + 1)


def fit_temperature(
    df: DataFrame, logits: str = "logits", true_index: str = "true_index", points: int = 16, rounds: int = 6
) -> float:
    """Temperature in [LOW, HIGH] with the least mean log loss.

    The loss is convex in b = 1/T. Each round is one aggregation that gives the
    slope at ``points`` values of b and narrows the bracket around its sign
    change; a bracket that starts beyond the minimum ends at its bound.
    """
    lo, hi = 1.0 / HIGH, 1.0 / LOW
    for _ in range(rounds):
        grid = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
        means = [F.avg(_slope(F.col(logits), F.col(true_index), b)) for b in grid]
        slopes = list(df.agg(*means).first())
        if slopes[0] is None:
            return 1.0
        if slopes[0] >= 0:
            return 1.0 / grid[0]
        if slopes[-1] <= 0:
            return 1.0 / grid[-1]
        up = next(i for i, g in enumerate(slopes) if g > 0)
        lo, hi = grid[up - 1], grid[up]
    return 2.0 / (lo + hi)


def calibration_report(
    df: DataFrame, model_name: str, dataset: str, logits: str = "logits", true_index: str = "true_index"
) -> DataFrame:
    """One row: temperature, model_name, dataset, nll_before, nll_after, n_examples."""
    t = fit_temperature(df, logits, true_index)

    y, z = F.col(true_index), F.col(logits)
    return df.agg(
        F.lit(t).alias("temperature"),
        F.lit(model_name).alias("model_name"),
        F.lit(dataset).alias("dataset"),
        F.avg(log_loss(z, y, 1.0)).alias("nll_before"),
        F.avg(log_loss(z, y, t)).alias("nll_after"),
        F.count(F.lit(1)).alias("n_examples"),
    )


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def read_temperature(spark: SparkSession, path: str) -> float:
    """Saved temperature; 1.0 when nothing was saved."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return 1.0
    row = spark.read.schema("temperature DOUBLE").json(path).first()
    return 1.0 if row is None or row["temperature"] is None else row["temperature"]
