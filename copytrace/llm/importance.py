"""Importance resampling of documents towards a target distribution.

Features are all runs of 1 to ``LONGEST`` words, hashed to ``BUCKETS`` buckets.
A bucket's gain is the logarithm of its smoothed share of the target's
features over its share of the documents', in thousandths, rounded down; a
document's weight is the sum of the gains of its features. Weights plus noise
that depends on the id alone (Gumbel) make scores, and the highest scores among
the documents of at least ``MIN_WORDS`` words are drawn: a sample without
replacement in proportion to the exponential of the weights.

Each Arrow batch interns its n-grams in an open-addressed NumPy table
(``interning``) whose slots have an n-gram's bucket and its count. The first
pass sums the counts by bucket, in each task and then over all; the second pass
gathers the gains by the occurrences' slots. Only the buckets' counts reach the
driver. Ranks come from a range-partitioned sort: a row's place in its
partition, and the rows of the partitions before it.

Defined cases: a null or empty text has no words and no features, weight 0 and
is never drawn; a null id has the noise of an empty id and sorts last among
equal scores; rows that share an id are scored and drawn one by one, ties among
them by a hash of the text; with an empty target or no documents the smoothed
shares remain; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from copytrace.llm.common import documents, prepare, rank_by, spread, text_of
from copytrace.llm.interning import ngrams, words
from copytrace.session import materialize
from copytrace.sources.tables import read_table

LONGEST = 3
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = 42


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): occurrences of the features of all texts; buckets without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for table, _, _ in ngrams(words(batch.column(0)), longest, buckets):
                np.add.at(total, table.bucket, table.count)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    source = spread(texts.select(text_of(text_col).alias("text")))
    return source.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, from the counts (bucket, n) of both sides; ``buckets`` rows of each reach the driver."""
    counts = []
    for table in (documents, target):
        found = np.zeros(buckets, np.int64)
        for bucket, n in table.collect():
            found[bucket] = n
        counts.append(found)
    s, t = counts
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    shares = [(float(b + 1) * all_s) / (float(a + 1) * all_t) for a, b in zip(s.tolist(), t.tolist())]
    return np.array([math.floor(1000 * math.log(x)) for x in shares], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variable, rounded down; the same for the same id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(id, mark, n_words, n_features, weight) of every row; ``mark`` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many, found = batch.num_rows, words(batch.column("text"))
            features, weight = np.zeros(many, np.int64), np.zeros(many, np.int64)
            for table, slot, owner in ngrams(found, longest, len(gains)):
                worth = gains[table.bucket][slot]
                features += np.bincount(owner, minlength=many)
                # Sums of whole numbers far below 2**53, so exact.
                weight += np.bincount(owner, worth, many).astype(np.int64)
            new = [pa.array(x.astype(np.int64)) for x in (np.bincount(found.text, minlength=many), features, weight)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), *new], schema.fieldNames())

    source = spread(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")))
    source = source.select("id", F.xxhash64("text").alias("mark"), "text")
    schema = StructType([*source.schema.fields[:2], *(StructField(c, LongType()) for c in ("n_words", "n_features", "weight"))])
    return source.mapInArrow(run, schema)


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row; undrawn rows have no rank."""
    gains = bucket_gains(
        bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets), buckets
    )
    scored = weigh(docs, gains, id_col, text_col, longest).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = materialize(scored, "scored")
    long_enough = F.col("n_words") >= min_words
    drawn = percent * scored.where(long_enough).count() // 100
    ranked = rank_by(scored, (~long_enough).asc(), F.desc("score"), F.asc_nulls_last("id"), F.col("mark").asc())
    return ranked.drop("mark").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))


def op13_importance(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document, drawn towards the benchmark's texts."""
    found = resample(documents(spark, folder), read_table(prepare(spark), folder, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


# CRC-32 by its table of 256 remainders, byte by byte over the hexadecimal digits of the UTF-8 text.
_CRC = """list_reduce([4294967295] || [('0x' || substr(hx, 2 * i - 1, 2))::BIGINT FOR i IN range(1, len(hx) // 2 + 1)],
  lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1]))"""
SQL = f"""WITH crc AS (SELECT list(list_reduce([i::BIGINT] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tbl
  FROM range(256) AS r(i)),
x AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM x),
f AS (SELECT side, id, unnest(flatten([[array_to_string(ws[i:i + n - 1], ' ') FOR i IN range(1, len(ws) - n + 2)] FOR n IN range(1, {LONGEST + 1})])) AS gram FROM w),
g AS (SELECT side, id, gram, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT gram, xor({_CRC}, 4294967295) % {BUCKETS} AS bucket FROM (SELECT gram, hex(gram) AS hx FROM g GROUP BY gram), crc),
c AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 't'), 0)::DOUBLE AS t
  FROM g JOIN b USING (gram) GROUP BY bucket),
v AS (SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM c) + {BUCKETS})) / ((s + 1) * ((SELECT sum(t) FROM c) + {BUCKETS}))))::BIGINT AS gain FROM c),
p AS (SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM g JOIN b USING (gram) JOIN v USING (bucket) WHERE side = 'd' GROUP BY id),
q AS (SELECT id, len(ws) >= {MIN_WORDS} AS fit, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  ('0x' || substr(sha256('{SEED}:' || id), 1, 8))::BIGINT AS h FROM w LEFT JOIN p USING (id) WHERE side = 'd'),
s AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM q),
k AS (SELECT *, row_number() OVER (ORDER BY fit DESC, score DESC, id) AS place FROM s)
SELECT id AS doc_id, n_features, weight, score,
  CASE WHEN place <= {PERCENT} * (SELECT count(*) FROM q WHERE fit) // 100 THEN place END AS rank FROM k"""
