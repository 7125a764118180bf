"""Descriptive text statistics, computed inside each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copytrace.functions import text as T
from copytrace.functions.numeric import round_even


def spread_of(lengths: Column) -> Column:
    """Population standard deviation of an integer array, from exact sums."""
    n = F.greatest(F.size(lengths), F.lit(1)).cast("double")
    total = F.aggregate(lengths, F.lit(0.0), lambda acc, x: acc + x)
    squares = F.aggregate(lengths, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    return F.sqrt(n * squares - total * total) / n


STATS = ("word_count", "sentence_count", "reading_time", "avg_sentence_length", "lexical_diversity", "burstiness")


def text_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus the six statistics. Blank text has zero words and sentences."""
    # Separate steps, so that each array is computed once.
    arrays = df.withColumn("_words", T.words(F.col(text))).withColumn(
        "_lengths", F.transform(T.sentences(F.col(text)), lambda s: F.size(T.words(s)))
    )
    counted = (
        arrays.withColumn("_w", F.size("_words"))
        .withColumn("_s", F.size("_lengths"))
        .withColumn(
            "_distinct", F.size(F.array_distinct(F.transform("_words", lambda w: F.btrim(F.lower(w), F.lit(T.WORD_EDGE)))))
        )
        .withColumn("_sd", spread_of(F.col("_lengths")))
    )
    w = F.col("_w")
    stats = {
        "word_count": w.cast("long"),
        "sentence_count": F.col("_s").cast("long"),
        "reading_time": F.greatest(F.lit(1), F.rint(w / F.lit(float(T.WORDS_PER_MINUTE)))).cast("long"),
        "avg_sentence_length": round_even(w / F.greatest(F.lit(1), F.col("_s")), 2),
        "lexical_diversity": F.when(w == 0, F.lit(0.0)).otherwise(round_even(F.col("_distinct") / w, 3)),
        "burstiness": F.when(F.col("_s") > 1, round_even(F.col("_sd"), 2)).otherwise(F.lit(0.0)),
    }
    return counted.select(*df.columns, *[stats[c].alias(c) for c in STATS])
