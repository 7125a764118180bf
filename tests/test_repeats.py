import random

import pytest
from pyspark.sql import functions as F

import brute
from copytrace.operators import repeats


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def plain_count(text, above):
    sents = brute.sentences(text)
    idf = brute.fit(sents + sents, 1)
    vecs = [brute.vector(s, idf, 1) for s in sents]
    return sum(any(round(100 * brute.dot(v, w), 2) > above for j, w in enumerate(vecs) if j != i) for i, v in enumerate(vecs))


def random_texts(seed, n, words):
    """Texts whose sentences are often slightly changed copies of earlier ones."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        sents = []
        for _ in range(rng.randint(1, 25)):
            if sents and rng.random() < 0.4:
                words_of = rng.choice(sents).split()
                words_of[rng.randrange(len(words_of))] = rng.choice(words)
                sents.append(" ".join(words_of))
            else:
                sents.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))))
        texts.append(" ".join(s + "." for s in sents))
    return texts


@pytest.mark.parametrize("above", [40.0, 70.0, 90.0])
def test_counts_equal_brute_force(spark, above):
    words = ["the", "of", "and"] * 6 + [f"w{i}x" for i in range(25)]
    texts = random_texts(3, 25, words) + ["", "Only one.", "Same. Same. Same. ok go.", "! ? ! ?", "a. a. a.", "Red fox. Fox red. Red fox!"]
    got = {r["doc_id"]: r["repeated"] for r in repeats.repeated_sentences(frame(spark, texts), above).collect()}
    assert [got.get(i, 0) for i in range(len(texts))] == [plain_count(t, above) for t in texts]
    assert sum(got.values()) > 20


def test_candidates_are_few_and_complete(spark):
    words = [f"w{i}x" for i in range(200)]
    texts = random_texts(8, 10, words)
    terms = repeats.sentence_terms(frame(spark, texts)).cache()
    every = terms.alias("x").join(terms.alias("y"), ["doc_id", "term"]).where("x.id < y.id")
    scored = every.groupBy("doc_id", F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.sum(F.col("x.w") * F.col("y.w")).alias("s"))
    pairs = {tuple(r) for r in repeats.candidate_pairs(terms, 0.7).collect()}
    near = {(r["doc_id"], r["a"], r["b"]) for r in scored.where("s >= 0.7").collect()}
    assert near and near <= pairs and len(pairs) < scored.count() / 2


def test_empty_table_and_null_text(spark):
    assert repeats.repeated_sentences(frame(spark, []).limit(0), 70.0).count() == 0
    assert repeats.repeated_sentences(frame(spark, [None, None]), 70.0).count() == 0


def test_a_long_text_is_the_work_of_many_tasks(spark):
    rng = random.Random(1)
    sents = [" ".join(f"w{rng.randrange(5000)}x" for _ in range(8)) + "." for _ in range(20_000)]
    planted = sorted(rng.sample(range(20_000), 300))
    for k in planted:
        sents[k] = sents[k][:-1] + f" u{k}x."
    text = " ".join(sents + [sents[k] for k in planted[:100]] + [sents[k][:-1] + " more." for k in planted[100:]])
    df = frame(spark, [text, "Owls hunt at night. Bread rises."])
    terms = repeats.sentence_terms(df)
    spread = terms.where("doc_id = 0").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < sum(r["count"] for r in spread) / 2
    got = {r["doc_id"]: r["repeated"] for r in repeats.repeated_sentences(df, 70.0).collect()}
    assert got == {0: 600, 1: 0}
