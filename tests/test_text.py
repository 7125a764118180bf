import math
import statistics

from pyspark.sql import functions as F

from copytrace.functions import text as T
from copytrace.functions.ranking import shuffled_rank
from copytrace.operators.statistics import text_stats
from copytrace.operators.vectorize import _attach_large, attach_vocabulary, document_frequency, postings, smoothed_idf
from copytrace.session import materialize


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("r")).first()["r"]


def test_clean(spark):
    assert one(spark, "Hello,   World!\n Été_1  x", T.clean) == "hello world été_1 x"
    assert one(spark, " ... ", T.clean) == ""


def test_sentences(spark):
    assert one(spark, "One. Two! Three?  Four", T.sentences) == ["One.", "Two!", "Three?", "Four"]
    assert one(spark, "Dr. Smith left.\nBye", T.sentences) == ["Dr.", "Smith left.", "Bye"]
    assert one(spark, " \n\t ", T.sentences) == []
    assert one(spark, "", T.sentences) == []


def test_tokens_and_ngrams(spark):
    assert one(spark, "A big été, a x big!", T.tokens) == ["big", "été", "big"]
    assert one(spark, "ab cd ef", lambda t: T.ngrams(T.tokens(t), 2)) == ["ab", "cd", "ef", "ab cd", "cd ef"]
    assert one(spark, "ab", lambda t: T.ngrams(T.tokens(t), 2)) == ["ab"]
    assert one(spark, "", lambda t: T.ngrams(T.tokens(t), 2)) == []


def test_label_class(spark):
    names = ["Real", "FAKE", "human", "machine-made", "LABEL_0", "real ai"]
    df = spark.createDataFrame([(n,) for n in names], "t string").select(T.label_class(F.col("t")))
    assert [r[0] for r in df.collect()] == ["human", "ai", "human", "ai", None, "ai"]


def test_postings_count_in_row(spark):
    df = spark.createDataFrame([(1, "bb aa bb cc bb"), (2, "x"), (3, "aa")], "id int, text string")
    rows = {(r["id"], r["term"]): r["tf"] for r in postings(df, ["id"]).collect()}
    assert rows == {(1, "aa"): 1, (1, "bb"): 3, (1, "cc"): 1, (3, "aa"): 1}


def test_text_stats(spark):
    text = "The cat sat. The cat sat again on the mat! Why?"
    r = text_stats(spark.createDataFrame([(text,)], "text string")).first()
    lengths = [3, 7, 1]
    assert (r["word_count"], r["sentence_count"], r["reading_time"]) == (11, 3, 1)
    assert r["avg_sentence_length"] == round(11 / 3, 2)
    assert r["lexical_diversity"] == round(7 / 11, 3)
    assert r["burstiness"] == round(statistics.pstdev(lengths), 2)
    blank = text_stats(spark.createDataFrame([(" ",)], "text string")).first()
    assert (blank["word_count"], blank["sentence_count"], blank["reading_time"]) == (0, 0, 1)
    assert (blank["lexical_diversity"], blank["burstiness"], blank["avg_sentence_length"]) == (0.0, 0.0, 0.0)


def test_reading_time_rounds_to_even(spark):
    rows = spark.createDataFrame([("w " * 500,), ("w " * 700,)], "text string")
    assert [r["reading_time"] for r in text_stats(rows).collect()] == [2, 4]


def test_large_vocabulary_join_equals_broadcast(spark):
    df = spark.createDataFrame([(i, f"common word{i % 7} only{i}") for i in range(60)], "id int, text string")
    post = postings(df, ["id"])
    vocab = document_frequency(post).filter("term != 'word3'").withColumn("idf", smoothed_idf(60))
    vocab = materialize(vocab, "v")
    total = vocab.agg(F.sum("df")).first()[0]
    plain = attach_vocabulary(post, vocab, ["id"], ["idf"]).select("id", "term", "tf", "idf")
    # Every term over a 2000th is heavy here; a huge total leaves none heavy.
    for t in (total, 10**9, 60 * 2000 - 1):
        large = _attach_large(post, vocab, ["id"], ["idf"], t).select("id", "term", "tf", "idf")
        assert sorted(large.collect()) == sorted(plain.collect())
    assert plain.filter("term = 'word3'").count() == 0
    assert math.isclose(plain.filter("term = 'common'").first()["idf"], 1.0)


def test_shuffled_rank_is_a_permutation(spark):
    df = spark.range(3000).withColumn("g", F.col("id") % 3)
    ranks = shuffled_rank(df, ["id"], 7).collect()
    assert sorted(r["rank"] for r in ranks) == list(range(1, 3001))
    by = shuffled_rank(df, ["id"], 7, by=["g"]).filter("g = 1").collect()
    assert sorted(r["rank"] for r in by) == list(range(1, 1001))
    again = shuffled_rank(df.repartition(5), ["id"], 7).collect()
    assert {r["id"]: r["rank"] for r in ranks} == {r["id"]: r["rank"] for r in again}
