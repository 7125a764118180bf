"""Exact global ranks without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copytrace.session import materialize


def bucket_offsets(counts: DataFrame, by: Sequence[str], amount: str, out: str) -> DataFrame:
    """Sum of ``amount`` over all lower buckets of the same ``by`` group.

    ``counts`` holds one row per (by, bucket): at most buckets x groups rows.
    """
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(amount).over(before), F.lit(0)))


def seeded_hash(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def shuffled_rank(df: DataFrame, keys: Sequence[str], seed: int, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Exact 1-based position of each row in a seeded permutation.

    ``keys`` identify a row. The hash prefix cuts the permutation into 4096
    even slices; a small table of slice sizes gives each slice its offset, and
    only rows of one slice are ever sorted together.
    """
    by = list(by)
    hashed = df.withColumn("_h", seeded_hash(seed, *keys)).withColumn("bucket", F.substring("_h", 1, 3))
    group = [*by, "bucket"]
    counts = hashed.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    # One constant group when `by` is empty: 4096 rows at most.
    offsets = bucket_offsets(counts, by or [F.lit(0)], "_n", "_before").drop("_n")
    inner = Window.partitionBy(*group).orderBy("_h", *keys)
    ranked = hashed.withColumn("_in", F.row_number().over(inner))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return (
        ranked.alias("a")
        .join(offsets.alias("b"), cond, "inner")
        .select(*[F.col(f"a.{c}") for c in df.columns], (F.col("_in") + F.col("_before")).cast("long").alias(out))
    )


def numbered(df: DataFrame, out: str, name: str) -> DataFrame:
    """``df`` written, with consecutive numbers from 0 in ``out``: a row's place in its partition after all earlier partitions."""
    placed = materialize(df.withColumn(out, F.monotonically_increasing_id()), name)
    # The upper bits tell the partition, the lower 33 the place in it.
    part = F.shiftright(out, 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    found = placed.join(F.broadcast(starts), part == F.col("_part"))
    return found.select(*df.columns, (F.col("_start") + F.col(out).bitwiseAND((1 << 33) - 1)).alias(out))
