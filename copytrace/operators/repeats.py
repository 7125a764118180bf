"""Sentences that a text repeats: a cosine join at a fixed threshold.

``similarity.self_repetition`` finds every sentence's best partner. Whether
there is any partner above a threshold needs less: terms are ordered from the
rarest to the most common, and two unit vectors of product t or more share
their first common term while both still hold a length of t from that term on.
Only those leading terms are joined, and at the first common term the rest of
the product is bounded by the lengths that are left (Cauchy-Schwarz). What
passes is multiplied out.

Usual documents are dealt once, by their id, and everything up to the weights
happens where they lie. Documents of over ``LONG_CHARS`` are partitioned by term
and by sentence instead, and so are all pairs, so that a very long document is
the work of many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copytrace.functions import text as T
from copytrace.functions.numeric import percent
from copytrace.operators.vectorize import explode_whole, parts_for, postings, smoothed_idf
from copytrace.session import materialize

# Bounds are loosened by this much for rounding; scores are not.
SLACK = 1e-9
LONG_CHARS = 500_000


def sentence_terms(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """doc_id, id, copies, term, w, rest, first of every distinct sentence with a token in a text of several.

    Terms that other sentences hold too, and each sentence's first term (flag
    ``first``). ``id`` is the sentence's first place; ``w`` its weight of unit
    length, with the idf of the document's sentence list; ``rest`` the squared
    length from the term on, rare terms first, null for a term that is in no
    other sentence or has less than the square of ``least`` left.
    """
    chars = F.coalesce(F.char_length("text"), F.lit(0))
    # A given number of parts, so that a part and what is made of its texts stay small at every size.
    usual = docs.filter(chars <= LONG_CHARS)
    usual = usual.repartition(parts_for(usual)[0], "doc_id")
    return _weighed(usual, least).unionByName(_weighed(docs.filter(chars > LONG_CHARS), least))


def _weighed(docs: DataFrame, least: float) -> DataFrame:
    split = docs.select("doc_id", T.sentences(F.col("text")).alias("_s")).select("doc_id", F.size("_s").alias("n"), "_s")
    sents = explode_whole(split, ["doc_id", "n"], F.posexplode_outer("_s").alias("sent_idx", "text"), "text")
    distinct = sents.filter(F.col("n") > 1).groupBy("doc_id", "text").agg(
        F.min("sent_idx").alias("id"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")
    )
    post = postings(distinct, ["doc_id", "id", "copies", "n"])
    term = Window.partitionBy("doc_id", "term")
    post = post.withColumn("df", F.sum("copies").over(term)).withColumn("rows", F.count(F.lit(1)).over(term))
    # Fitted on the sentence list taken twice: both counts double.
    raw = post.withColumn("raw", F.col("tf") * smoothed_idf(F.col("n") * 2, F.col("df") * 2))
    sentence = Window.partitionBy("doc_id", "id")
    earlier = sentence.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    square = F.col("raw") * F.col("raw")
    raw = raw.withColumn("all", F.sum(square).over(sentence)).withColumn("before", F.sum(square).over(earlier))
    rest = F.lit(1.0) - F.coalesce("before", F.lit(0.0)) / F.col("all")
    shared = F.col("rows") > 1
    weighed = raw.withColumn("rest", rest).withColumn("first", F.col("before").isNull()).filter(shared | F.col("first"))
    leading = F.when(shared & (F.col("rest") >= least * least - SLACK), F.col("rest"))
    return weighed.select("doc_id", "id", "copies", "term", (F.col("raw") / F.sqrt("all")).alias("w"), leading.alias("rest"), "first")


def candidate_pairs(terms: DataFrame, least: float) -> DataFrame:
    """doc_id, a, b (a < b): all pairs of sentences whose product may reach ``least``."""
    left_over = F.sqrt(F.greatest(F.col("rest") - F.col("w") * F.col("w"), F.lit(0.0)))
    leading = terms.filter(F.col("rest") >= least * least - SLACK)
    a = leading.select("doc_id", "term", F.col("id").alias("a"), F.col("w").alias("wa"), left_over.alias("la"))
    b = leading.select("doc_id", "term", F.col("id").alias("b"), F.col("w").alias("wb"), left_over.alias("lb"))
    bound = F.col("wa") * F.col("wb") + F.col("la") * F.col("lb") >= least - SLACK
    return a.join(b, ["doc_id", "term"]).filter((F.col("a") < F.col("b")) & bound).select("doc_id", "a", "b").distinct()


def similar_sentences(terms: DataFrame, above: float) -> DataFrame:
    """doc_id, id of the sentences with another distinct one of their text at a similarity over ``above`` percent."""
    pairs = materialize(candidate_pairs(terms, above / 100), "pairs")
    asked = pairs.select("doc_id", F.explode(F.array("a", "b")).alias("id")).distinct()
    held = terms.join(asked, ["doc_id", "id"], "left_semi").groupBy("doc_id", "id")
    vectors = materialize(held.agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("v")), "vectors")
    both = pairs.join(vectors.select("doc_id", F.col("id").alias("a"), F.col("v").alias("va")), ["doc_id", "a"])
    both = both.join(vectors.select("doc_id", F.col("id").alias("b"), F.col("v").alias("vb")), ["doc_id", "b"])
    product = F.aggregate(
        F.map_entries("va"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("vb", e["key"]), F.lit(0.0))
    )
    found = both.filter(percent(product) > above)
    return found.select("doc_id", F.explode(F.array("a", "b")).alias("id")).distinct()


def repeated_sentences(docs: DataFrame, above: float) -> DataFrame:
    """doc_id, repeated: sentences of the text that have another one at a similarity over ``above`` percent.

    The same counts as from ``self_repetition``. Texts of one sentence or
    without a token are absent. Each id stands once.
    """
    terms = materialize(sentence_terms(docs, above / 100), "sentterms")
    found = similar_sentences(terms, above).withColumn("hit", F.lit(True))
    sents = terms.filter("first").select("doc_id", "id", "copies").join(found, ["doc_id", "id"], "left")
    counted = F.when((F.col("copies") > 1) | F.col("hit"), F.col("copies")).otherwise(0)
    return sents.groupBy("doc_id").agg(F.sum(counted).alias("repeated"))
