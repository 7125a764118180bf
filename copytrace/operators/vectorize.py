"""Term counts, document frequencies and TF-IDF weights as long tables.

A *posting* is one row ``(keys..., term, tf)``. Terms of one text are counted
inside the row that holds the text, so making postings moves no data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copytrace.functions import text as T
from copytrace.session import BROADCAST_BYTES, materialize

# A vocabulary row (term, counts, idf) takes about this much in a hash table.
VOCAB_ROW_BYTES = 96
# A term is heavy when it holds over 1/HEAVY_SHARE of all postings; there can
# be fewer than HEAVY_SHARE such terms, whatever the size of the corpus.
HEAVY_SHARE = 2000
# Texts are dealt into parts of about so many characters, whose distinct terms are looked up together.
PART_CHARS = 2_000_000
# With a longer text than this its part's terms are sorted, not hashed: a sort may spill.
LONG_CHARS = 5_000_000


def explode_whole(df: DataFrame, keys: Sequence[str], generator: Column, value: str) -> DataFrame:
    """Explode with an outer generator and drop the rows of empty arrays.

    A plain explode makes the optimizer test the array's size in a pushed-down
    filter, which evaluates the whole array expression a second time.
    """
    return df.select(*keys, generator).filter(F.col(value).isNotNull())


def with_sentences(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row per sentence: keys, sent_idx (0-based), sentence."""
    gen = F.posexplode_outer(T.sentences(F.col(text))).alias("sent_idx", "sentence")
    return explode_whole(df, keys, gen, "sentence")


def postings(df: DataFrame, keys: Sequence[str], text: str = "text", n: int = 1) -> DataFrame:
    """keys, term, tf. Equal terms are runs of the sorted term list."""
    cols = list(keys)
    runs = (
        df.select(*cols, T.tokens(F.col(text)).alias("_tok"))
        .select(*cols, F.sort_array(T.ngrams(F.col("_tok"), n)).alias("_s"))
        .select(
            *cols,
            "_s",
            F.array_compact(
                F.transform("_s", lambda x, i: F.when((i == 0) | (x != F.get("_s", i - 1)), i))
            ).alias("_at"),
        )
        .select(
            *cols,
            F.transform(
                "_at",
                lambda p, j: F.struct(
                    F.get("_s", p).alias("term"),
                    (F.coalesce(F.get("_at", j + 1), F.size("_s")) - p).alias("tf"),
                ),
            ).alias("_runs"),
        )
    )
    return explode_whole(runs, cols, F.inline_outer("_runs"), "term")


def parts_for(df: DataFrame, text: str | Column = "text") -> tuple[int, bool]:
    """Number of parts for texts to be dealt into, and whether a single text is too long for its part's terms to be hashed."""
    chars = F.char_length(text)
    size = df.agg(F.coalesce(F.sum(chars), F.lit(0)).alias("all"), F.coalesce(F.max(chars), F.lit(0)).alias("most")).first()
    return max(1, -(-size["all"] // PART_CHARS)), size["most"] > LONG_CHARS


def part_of(parts: int, *keys: str | Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def counts_by_part(post: DataFrame, sums: Mapping[str, Column]) -> DataFrame:
    """part, term, sums..., first: the sums of a term over all of ``post``, on one row for each part that holds it.

    ``post`` lies by ``part``. Only the distinct terms of every part are moved,
    and no term has more rows than there are parts. ``first`` marks one row of each term.
    """
    local = post.groupBy("part", "term").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    term = Window.partitionBy("term")
    total = [F.sum(name).over(term).alias(name) for name in sums]
    return local.select("part", "term", *total, (F.col("part") == F.min("part").over(term)).alias("first"))


def attach_by_part(post: DataFrame, terms: DataFrame, parts: int, long: bool) -> DataFrame:
    """``post`` with the columns of ``terms(part, term, ...)``; the postings stay where they lie."""
    return post.join(terms.repartitionById(parts, F.col("part")).hint("merge" if long else "shuffle_hash"), ["part", "term"])


def smoothed_idf(n: int | Column, df: str | Column = "df") -> Column:
    """ln((1 + n) / (1 + df)) + 1."""
    n = F.lit(n) if isinstance(n, int) else n
    df = F.col(df) if isinstance(df, str) else df
    return F.log((n + F.lit(1.0)) / (df + F.lit(1.0))) + F.lit(1.0)


def document_frequency(post: DataFrame, weight: Column | None = None) -> DataFrame:
    """term, df: rows holding the term (each counted ``weight`` times)."""
    df = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return post.groupBy("term").agg(df.cast("long").alias("df"))


def max_df_vocabulary(vocab: DataFrame, n: int, max_df: float) -> DataFrame:
    """Terms found in at most ``max_df`` of the ``n`` rows."""
    return vocab.filter(F.col("df") <= F.lit(max_df * n))


def attach_vocabulary(
    post: DataFrame, vocab: DataFrame, keys: Sequence[str], cols: Sequence[str], row_bytes: int = VOCAB_ROW_BYTES
) -> DataFrame:
    """Join vocabulary columns to postings; terms outside it are dropped.

    ``vocab`` should be a stored table with ``term``, ``df`` and ``cols``. A
    small one is broadcast. Otherwise the few heavy terms, which would overload
    one partition each, are broadcast and the rest is joined by a shuffle.
    """
    size = vocab.agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("total")).first()
    table = vocab.select("term", *cols)
    if size["terms"] * row_bytes <= BROADCAST_BYTES:
        return post.join(F.broadcast(table), "term")
    return _attach_large(post, vocab, keys, cols, size["total"])


def _attach_large(post: DataFrame, vocab: DataFrame, keys: Sequence[str], cols: Sequence[str], total: int) -> DataFrame:
    heavy = F.col("df") * F.lit(HEAVY_SHARE) > F.lit(total)
    top = vocab.filter(heavy).select(F.col("term").alias("_ht"), *[F.col(c).alias(f"_h_{c}") for c in cols])
    rest = vocab.filter(~heavy).select(F.col("term").alias("_lt"), *[F.col(c).alias(f"_l_{c}") for c in cols])
    # Heavy rows need nothing from the second join: a key that matches no term
    # spreads them over all partitions.
    spread = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*keys), F.lit(65536)).cast("string"))
    found = post.join(F.broadcast(top), F.col("term") == F.col("_ht"), "left")
    found = found.withColumn("_jk", F.when(F.col("_ht").isNotNull(), spread).otherwise(F.col("term")))
    found = found.join(rest, F.col("_jk") == F.col("_lt"), "left")
    found = found.filter(F.col("_ht").isNotNull() | F.col("_lt").isNotNull())
    merged = [F.coalesce(f"_h_{c}", f"_l_{c}").alias(c) for c in cols]
    return found.select(*post.columns, *merged)


def normalized_weights(post: DataFrame, keys: Sequence[str], hot: Column | None = None) -> DataFrame:
    """keys, term, w with unit length per key; ``post`` needs tf and idf.

    With ``hot`` also: that flag, and hot_norm, the length of the hot part.
    """
    row = Window.partitionBy(*keys)
    raw = post.withColumn("_w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(row))
    if hot is None:
        return raw.select(*keys, "term", (F.col("_w") / norm).alias("w"))
    hot_sq = F.sum(F.when(hot, F.col("_w") * F.col("_w")).otherwise(0.0)).over(row)
    return raw.select(
        *keys, "term", (F.col("_w") / norm).alias("w"), hot.alias("hot"), (F.sqrt(hot_sq) / norm).alias("hot_norm")
    )


def tfidf_weights(df: DataFrame, keys: Sequence[str], text: str = "text", n: int = 1, max_df: float = 1.0) -> DataFrame:
    """Fit on ``df`` and weigh its rows: keys, term, w."""
    rows = df.count()
    parts, long = parts_for(df, text)
    dealt = df.select(part_of(parts, *keys).alias("part"), *keys, text).repartitionById(parts, F.col("part"))
    post = postings(dealt, ["part", *keys], text, n)
    terms = counts_by_part(post, {"df": F.lit(1)})
    if max_df < 1.0:
        terms = max_df_vocabulary(terms, rows, max_df)
    terms = materialize(terms.select("part", "term", "df"), "partterms")
    known = attach_by_part(post, terms, parts, long).withColumn("idf", smoothed_idf(rows))
    return normalized_weights(known, ["part", *keys]).drop("part")
