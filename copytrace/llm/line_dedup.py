"""Line deduplication: drop lines that many documents share, keep them in one document.

Lines are exploded as positions and hashes of their normalised form, documents
are counted per hash, and each document is reassembled from its remaining lines
by position. All steps are built-in functions and linear in a text's lines.

A line's key is the line without white space (\\x20, \\x09-\\x0D) at both ends,
A-Z lower-cased. A key of at least ``min_chars`` code points found in at least
``min_docs`` documents loses all its lines, repeats included, except in the
largest id that holds it. Keys are compared as 128-bit hashes.

Defined cases: a null or empty text is one empty line; rows that share an id
count as one document and lose the same lines; null ids count together as one
document, the smallest. Rows meet the positions they lose by id and hash of the
text, so rows of one id or of none lie apart. An empty table gives an empty result; other columns
are carried along untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copytrace.llm.common import SPACES, UPPER, documents, text_of
from copytrace.session import fits_broadcast, materialize

MIN_CHARS = 40
MIN_DOCS = 5
# Memory of a key in a hash table, and of all keys that are broadcast.
KEY_BYTES = 96
MOST_BROADCAST = 32 << 20


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, UPPER.lower())


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _row_key(text: Column) -> Column:
    """What tells rows of one id apart; equal texts under one id lose the same lines."""
    return _hash(text)


def line_drops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, t, drops): the positions of the lines that the rows of an id and a text's hash lose; rows that keep all are left out."""
    text = text_of(text_col)
    keys = F.transform(_lines(text), lambda line, i: F.struct(i.alias("pos"), line_key(line).alias("key")))
    keys = F.filter(keys, lambda x: F.length(x["key"]) >= min_chars)
    marks = F.transform(keys, lambda x: F.struct(x["pos"].alias("pos"), _hash(x["key"]).alias("h")))
    # The text is hashed once, below the generator; an outer one keeps its array from being tested a second time.
    rows = docs.select(F.col(id_col).alias("id"), _row_key(text).alias("t"), marks.alias("marks"))
    rows = materialize(rows.select("id", "t", F.inline_outer("marks")).where("pos IS NOT NULL"), "lines")
    # Lines are at least as many as documents, so this keeps every key that can count; rows of one id merge below.
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("h")
    hits = materialize(rows.join(_small(often, "often"), "h").select("id", "t", "pos", "h"), "line-hits")
    holders = hits.select("id", "h").distinct()
    shared = holders.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).where(F.col("n") >= min_docs)
    lost = hits.join(_small(shared, "shared"), "h").where(~F.col("id").eqNullSafe(F.col("top")))
    return lost.groupBy("id", "t").agg(F.collect_set("pos").alias("drops"))


def _small(keys: DataFrame, name: str) -> DataFrame:
    """``keys`` written, and broadcast if counted to be small, so that lines need not meet by their hash.

    Beyond that the join is a shuffle whose crowded hashes AQE splits; the rows are the same.
    """
    keys = materialize(keys, name)
    return F.broadcast(keys) if fits_broadcast(keys, KEY_BYTES, MOST_BROADCAST) else keys


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(row, kept, n_lines, n_dropped): each input row as a struct, its remaining text and its counts."""
    drops = line_drops(docs, id_col, text_col, min_chars, min_docs)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own"), _row_key(text_of(text_col)).alias("key"))
    # Lines are split after the join: a text moves once.
    joined = rows.join(drops, rows.own.eqNullSafe(drops.id) & (rows.key == drops.t), "left")
    text = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    joined = joined.select("row", "drops", text.alias("text"), _lines(text).alias("lines"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drops")
    kept = F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n")
    return joined.select(
        "row",
        F.when(F.col("drops").isNull(), F.col("text")).otherwise(kept).alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    found = drop_lines(documents(spark, folder).select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT doc_id, pos, line, {_KEY} AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= {MIN_CHARS}
      GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT k.doc_id, pos, line, c.key IS NOT NULL AND k.doc_id <> c.top AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
