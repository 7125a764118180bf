"""Small tables for the operator tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """documents from (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def folder(tmp_path, spark: SparkSession, **tables: DataFrame) -> str:
    for name, table in tables.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def got(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
