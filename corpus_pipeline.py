"""Corpus pipeline: language ID, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, folder) and works on all rows its predecessor
kept; between stages the rows are a Parquet table in the shared folder. All
stages but the last return the columns of their input.

Defined cases, besides those of the operators: language ID rejects a document
whose text is null or has no letter, or whose language is ambiguous; line
dedup replaces the text by its remaining lines and n_chars, where it is there,
by their length, and a document that loses all lines stays as an empty text;
near-dedup links texts whose SimHash fingerprints (4-word shingles) differ in
at most 4 bits and keeps one row of each group: the smallest id, of several
rows under it the smallest hash of the text; documents without an id each stay
and link nothing; mixing repeats a row as often as it is taken. An empty table runs through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copytrace.llm import language, line_dedup, mixing, packing, simhash
from copytrace.llm.common import documents, prepare, text_of
from copytrace.session import materialize


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in one recognisable language."""
    prepare(spark)
    model = language.learn(docs, ~language.held_out())
    found = language.predict(docs, model)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & ~F.col("ambiguous")).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with their remaining lines."""
    prepare(spark)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    found = line_dedup.drop_lines(docs)
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies by SimHash."""
    prepare(spark)
    # Rows of one id are told apart by their text; a group's key is its smallest (id, hash).
    key = F.struct("doc_id", F.xxhash64(text_of()).alias("mark"))
    found = simhash.simhash_components(docs.where("doc_id IS NOT NULL").select(key.alias("key"), "text"), "key")
    first = found.where(F.col("id") == F.col("component")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    first = materialize(first.select("id.*", "n").withColumnRenamed("doc_id", "first"), "near-first")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own"), F.xxhash64(text_of()).alias("own_mark"))
    stay = rows.join(first, (F.col("own") == F.col("first")) & (F.col("own_mark") == F.col("mark")))
    single = stay.where("n = 1").select("row.*")
    several = stay.where("n > 1").groupBy("own", "own_mark").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return single.union(several).union(docs.where(F.col("doc_id").isNull()))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    prepare(spark)
    found = mixing.mix(docs, carry=True).where("copies > 0")
    return found.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def pack_windows(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents in their windows."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

# Language ID, the fingerprints and the tokenizer have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents table, each written before the next one reads it."""
    docs = documents(spark, folder)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
