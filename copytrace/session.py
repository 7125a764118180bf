"""Session helpers: where intermediate tables live and how sizes are checked."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Largest table (rows x bytes) that may be shipped whole to every executor.
BROADCAST_BYTES = 64 << 20
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession) -> SparkSession:
    """Settings the text operators rely on.

    Splitting and counting text costs much CPU per byte, so AQE may keep
    shuffle partitions far below its 1 MB floor while cores are idle. Large
    shuffles are not affected: their partitions are bigger anyway.

    Shuffle files go when the job that wrote them has ended; otherwise those of
    all earlier steps lie on the disks until the driver collects its garbage.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    # Tables partitioned by document join on (document, term) where they lie.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    go without, and then gets a throw-away folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="copytrace-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder, a folder for each value of ``by``, and read it back.

    Cuts the lineage so that a lost executor re-reads files instead of
    recomputing the whole chain, and gives later stages real table sizes.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and nothing will read any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go when it has ended, not when the driver collects its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def fits_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` holds at most ``limit`` bytes at ``row_bytes`` a row.

    Counting stops at the first row too many, so the check is cheap on a
    large table.
    """
    most = max(1, limit // row_bytes)
    return df.limit(most + 1).count() <= most
