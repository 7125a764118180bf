"""Mixing sources to target weights by systematic sampling.

A document's size is its number of words. Sources by code point, null last,
weigh 5, 2, 1, repeating, and share 150 % of all sizes. A target stops at twice
its source's size; the excess is shared again by weight until none is above.

Each document of a source expects target / source size copies. Within the
source the expected copies are summed up in document order, one random offset
in [0, 1) is added, and a document is emitted once per integer boundary it
crosses: 0, 1 or 2 times. The order runs by size class (eight to sixteen classes
per power of two), then by hash slice, so that a prefix of any length holds
its fair share of every size and the words taken come near the target. The
offset and the slices come from MD5, so reruns agree.

No source is sorted or numbered in one task: positions are an offset per size
class, an offset per slice and a row number inside the slice.

Defined cases: a null text has size 0; a source of size 0 gets target 0 and
none of its documents is taken; null sources are one source, sorted last; rows
that share an id each count on their own; an empty table gives an empty
result; other columns are carried along as a struct, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copytrace.llm.common import documents, text_of, word_count
from copytrace.session import materialize

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # all targets together: 3/2 of all sizes
CAP = 2


def _size_class(size: Column) -> Column:
    """Eight or more classes per power of two: the four leading bits and the power."""
    power = F.greatest(F.length(F.bin(size)) - 4, F.lit(0))
    return power * 16 + F.floor(size / F.pow(F.lit(2.0), power)).cast("int")


def _slice(id_text: Column) -> Column:
    return F.substring(F.md5(F.coalesce(id_text, F.lit(""))), 1, 2)


def _key(source: Column) -> Column:
    """A source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def _offset(source: Column) -> Column:
    """Random offset of a source: 20 bits of a hash, in [0, 1)."""
    digits = F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(source, F.lit("")))), 1, 5)
    return F.conv(digits, 16, 10).cast("double") / (1 << 20)


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with ``place``, from 0 in code point order, null last; ranges are sorted apart from each other."""
    dealt = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "sources")
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row per range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inner = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return dealt.withColumn("own", F.row_number().over(inner)).join(counts, "part").select("source", "source_size", (F.col("before") + F.col("own") - 1).alias("place"))


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) of ``sized(source, size)``.

    Each pass sums up sources that reach their cap under the level so far;
    the level rises until no further source does. The driver sees sums only.
    """
    sources = _numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    sources = materialize(sources.select("source", "source_size", weight.cast("long").alias("weight")), "targets")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    up, down = SHARE
    level, full = F.lit(0.0), None
    while True:
        capped = F.col("weight") * level > CAP * F.col("source_size")
        at_cap, weights, n = sources.agg(
            F.sum(F.when(capped, F.col("source_size")).otherwise(0)),
            F.sum(F.when(capped, 0).otherwise(F.col("weight"))),
            F.sum(capped.cast("long")),
        ).first()
        if n == full or not weights:
            break
        full = n
        spare = up * total - down * CAP * at_cap  # times 1 / down
        level = F.lit(float(spare)) / F.lit(float(down * weights))
    target = F.when(capped, (CAP * F.col("source_size")).cast("double")).otherwise(F.col("weight") * level)
    return sources.select("source", "source_size", F.least(target, (CAP * F.col("source_size")).cast("double")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """(id, size, source_size, target, copies) of every row, with ``row``, the whole input row, if ``carry``."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        _key(F.col(source_col).cast("string")).alias("key"),
        word_count(text_of(text_col)).alias("size"),
        *([F.struct("*").alias("row"), F.xxhash64(text_of(text_col)).alias("tie")] if carry else []),
    )
    small = materialize(rows.select("id", "source", "key", "size"), "sizes")
    rows = rows if carry else small.withColumn("tie", F.lit(0))
    # Never null as far as the optimizer can see: else it would test them for null below the join, counting the words again.
    place = {
        "class": F.coalesce(_size_class(F.col("size")), F.lit(-1)),
        "slice": F.coalesce(_slice(F.col("id").cast("string")), F.lit("")),
    }
    cells = small.withColumns(place).groupBy("key", "class", "slice").agg(F.count(F.lit(1)).alias("n"))
    cells = materialize(cells, "cells")
    earlier = Window.partitionBy("key", "class").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = cells.withColumn("in_class", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    earlier = Window.partitionBy("key").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = cells.groupBy("key", "class").agg(F.sum("n").alias("n"))
    classes = classes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    starts = slices.join(classes, ["key", "class"])
    starts = starts.select("key", "class", "slice", (F.col("before") + F.col("in_class")).alias("start"))
    targets = source_targets(small).select(_key(F.col("source")).alias("key"), "source_size", "target")
    # Written, so that the rows stay dealt by slice for the join and are not gathered by class.
    starts = materialize(starts.join(targets, "key"), "starts")
    inner = Window.partitionBy("key", "class", "slice").orderBy("size", "id", "tie")
    ranked = rows.withColumns(place).withColumn("own", F.row_number().over(inner))
    found = ranked.join(starts, ["key", "class", "slice"])
    at = F.col("start") + F.col("own")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor(rate * at + _offset(F.col("source"))) - F.floor(rate * (at - 1) + _offset(F.col("source")))
    keep = ["id", "size", "source_size", "target", crossed.cast("long").alias("copies")]
    return found.select(*(["row"] if carry else []), *keep)


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document."""
    found = mix(documents(spark, folder))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, source, {_SIZE} AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
      FROM d GROUP BY source),
lv(step, level, capped) AS (
  SELECT 0, 0.0::DOUBLE, -1::BIGINT
  UNION ALL
  SELECT step + 1,
         (3 * (SELECT sum(source_size) FROM s) - 4 * at_cap)::DOUBLE / (2 * weights)::DOUBLE, n
  FROM (SELECT step, capped, sum(CASE WHEN weight * level > 2 * source_size THEN source_size ELSE 0 END)::BIGINT AS at_cap,
               sum(CASE WHEN weight * level > 2 * source_size THEN 0 ELSE weight END)::BIGINT AS weights,
               count(*) FILTER (WHERE weight * level > 2 * source_size) AS n
        FROM lv, s GROUP BY step, capped)
  WHERE n <> capped AND weights > 0),
t AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, weight * level) AS target
      FROM s, (SELECT level FROM lv ORDER BY step DESC LIMIT 1)),
c AS (SELECT d.*, greatest(length(bin(size)) - 4, 0) AS power,
             substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2) AS slice FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY power * 16 + (size >> power), slice, size, doc_id) AS pos FROM c),
x AS (SELECT doc_id, size, source_size, target, pos,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
             ('0x' || substr(md5('mix:' || coalesce(r.source, '')), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * (floor(rate * pos + u) - floor(rate * (pos - 1) + u))::BIGINT AS taken FROM x"""
