import os
import random

import pytest
from pyspark.sql import functions as F

import brute
from copytrace.operators import index as I
from copytrace.operators import matching as M
from copytrace.operators import reuse as R
from copytrace.operators import vectorize as V
from copytrace.operators.rerank import rerank_lexical, rerank_model
from copytrace.session import new_path, shared_dir

OWL = "Owls hunt at night using quiet wings and sharp hearing."
BREAD = "Bakers let sourdough rise slowly so that the crust turns crisp."
CORPUS = [(1, OWL), (2, BREAD)]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")


@pytest.fixture(scope="module")
def small(spark):
    return I.build_index(docs(spark, CORPUS))


def random_corpus(seed, n):
    rng = random.Random(seed)
    common = ["the", "of", "and", "to", "in"]
    rare = [f"word{i}" for i in range(60)]

    def sentence():
        return " ".join(rng.choice(common if rng.random() < 0.5 else rare) for _ in range(rng.randint(1, 7))) + "."

    texts = [" ".join(sentence() for _ in range(rng.randint(0, 5))) for _ in range(n)]
    # A third of all documents are copies of one text.
    return [(i, texts[0] if i % 3 == 0 else t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("k", [1, 4])
def test_matches_equal_brute_force(spark, k):
    rows = random_corpus(3, 45)
    questions = [t for _, t in random_corpus(4, 10)] + [rows[0][1], "the of", "unseenword", ""]
    # hot_rows=3 makes most terms hot, so the pruned path does the work.
    ix = I.build_index(docs(spark, rows), hot_documents=3, hot_rows=3)
    sents = [(d, i, s) for d, t in rows for i, s in enumerate(brute.sentences(t))]
    idf = brute.fit([t for _, t in rows] + [s for _, _, s in sents], 2)
    doc_vec = [(d, brute.vector(t, idf, 2)) for d, t in rows]
    sent_vec = [((d, i), brute.vector(s, idf, 2)) for d, i, s in sents]
    q = asked(spark, *questions)

    found = {}
    for r in R.rank_documents(q, ix, k).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["source"], round(r["score"], 9)))
    for i, text in enumerate(questions):
        v = brute.vector(text, idf, 2)
        want = brute.best([(d, brute.dot(v, w)) for d, w in doc_vec], k)
        assert sorted(found.get(i, [])) == [(n + 1, d, round(s, 9)) for n, (d, s) in enumerate(want)]

    found = {}
    for r in R.sentence_candidates(R.query_sentences(q), ix, k).collect():
        found.setdefault((r["query_id"], r["sent_idx"]), []).append(
            (r["rank"], (r["source"], r["source_idx"]), round(r["score"], 9))
        )
    for i, text in enumerate(questions):
        for j, s in enumerate(brute.sentences(text)):
            v = brute.vector(s, idf, 2)
            want = brute.best([(key, brute.dot(v, w)) for key, w in sent_vec], k)
            assert sorted(found.get((i, j), [])) == [(n + 1, key, round(x, 9)) for n, (key, x) in enumerate(want)]


def test_verbatim_copy_and_unrelated(spark, small):
    q = asked(spark, OWL, "Quarterly revenue grew strongly.")
    ranking = {r["query_id"]: r for r in R.rank_documents(q, small, 1).collect()}
    assert ranking[0]["source"] == 1 and ranking[0]["similarity"] == 100.0
    assert 1 not in ranking
    scores = {r["query_id"]: r["score"] for r in R.reuse_scores(q, R.rank_documents(q, small)).collect()}
    assert scores == {0: 100.0, 1: 0.0}


def test_mixed_query_names_the_source(spark, small):
    q = asked(spark, f"{BREAD} Nobody expected rain yesterday.")
    rows = R.match_sentences(q, small).orderBy("sent_idx").collect()
    assert rows[0]["source"] == 2 and rows[0]["similarity"] > 70 and rows[0]["score_kind"] == "cosine"
    assert rows[1]["source"] is None and rows[1]["similarity"] == 0.0
    flags = R.flag_matches(R.match_sentences(q, small)).collect()
    assert [(r["sent_idx"], r["severity"]) for r in flags] == [(0, "high")]


def test_report(spark, small):
    r = R.reuse_report(asked(spark, f"{OWL} Plain filler.", ""), small).orderBy("query_id").collect()
    assert r[0]["matches"][0]["source"] == 1 and len(r[0]["sentence_matches"]) == 2
    assert r[1]["score"] == 0.0 and r[1]["matches"] == [] and r[1]["sentence_matches"] == []


def test_empty_corpus(spark):
    ix = I.build_index(docs(spark, []))
    r = R.reuse_report(asked(spark, OWL), ix).first()
    assert r["score"] == 0.0 and r["matches"] == []
    assert [m["source"] for m in r["sentence_matches"]] == [None]


def test_incremental_add_and_round_trip(spark, small):
    third = "Volcanoes release ash that darkens the sky for weeks."
    more = docs(spark, [(3, third), (1, "changed text stays out"), (4, OWL)])
    grown = I.add_documents(small, more)
    assert I.index_health(grown).first().asDict() == {"documents": 4, "sentences": 4, "detector": "heuristic"}
    # Only words known at build time count, so the new text matches by "that", "the".
    top = R.rank_documents(asked(spark, third), grown, 1).first()
    assert top["source"] == 3 and top["similarity"] == 100.0
    owls = R.rank_documents(asked(spark, OWL), grown, 3).orderBy("rank").collect()
    assert [r["source"] for r in owls[:2]] == [1, 4]
    oov = {r["doc_id"]: r["oov_ratio"] for r in I.out_of_vocabulary(small, more).collect()}
    assert oov[4] == 0.0 and 0.5 < oov[3] < 1.0

    path = new_path(spark, "ix")
    I.save_index(small, path)
    I.append_to_saved(spark, path, more)
    I.append_to_saved(spark, path, more)  # nothing left to add
    loaded = I.load_index(spark, path)
    assert I.index_health(loaded).first()["documents"] == 4
    a = [tuple(r) for r in R.rank_documents(asked(spark, OWL), loaded, 3).collect()]
    assert sorted(a) == sorted(tuple(r) for r in owls)
    again = new_path(spark, "ix")
    I.save_index(loaded, again)
    assert I.index_health(I.load_index(spark, again)).first()["sentences"] == 4


def test_unfinished_append_is_ignored_and_repeated(spark, small):
    path = new_path(spark, "ix")
    I.save_index(small, path)
    folder = I._state(spark, path).folder
    left_over = small.sentences.withColumn("doc_id", F.lit(9)).drop("batch")
    left_over.write.parquet(f"{path}/{folder}/sentences/batch=1")
    assert I.index_health(I.load_index(spark, path)).first()["sentences"] == 2
    I.append_to_saved(spark, path, docs(spark, [(9, "Rain fell. Owls hunt.")]))
    assert I.index_health(I.load_index(spark, path)).first()["sentences"] == 4


def test_saving_over_a_grown_index_forgets_it(spark, small):
    path = new_path(spark, "ix")
    with pytest.raises(FileNotFoundError):
        I.load_index(spark, path)
    I.save_index(small, path)
    I.append_to_saved(spark, path, docs(spark, [(9, "Rain fell.")]))
    I.save_index(I.build_index(docs(spark, [(7, OWL)])), path)
    assert [r["doc_id"] for r in I.load_index(spark, path).documents.collect()] == [7]
    I.append_to_saved(spark, path, docs(spark, [(8, "b"), (8, "a"), (7, "other")]))
    assert sorted((r["doc_id"], r["text"]) for r in I.load_index(spark, path).documents.collect()) == [(7, OWL), (8, "a")]


def test_overlay(spark):
    extra = docs(spark, [(2, "new"), (5, "five")])
    rows = {r["doc_id"]: r["text"] for r in I.overlay(docs(spark, CORPUS), extra).collect()}
    assert rows == {1: OWL, 2: "new", 5: "five"}


def candidates(spark, query, cands):
    rows = [(0, 0, query, i + 1, c, 0.5) for i, c in enumerate(cands)]
    return spark.createDataFrame(
        rows, "query_id bigint, sent_idx int, sentence string, rank int, matched_sentence string, score double"
    )


def test_rerank_lexical(spark):
    c = candidates(spark, "red fox jumps", ["blue sea", "red fox jumps", "a red fox", "sea blue"])
    rows = rerank_lexical(c).orderBy("rerank_rank").collect()
    assert [r["rank"] for r in rows] == [2, 3, 1, 4]  # ties keep candidate order
    assert [r["rerank_score"] for r in rows] == [1.0, 0.5, 0.0, 0.0]
    assert rerank_lexical(candidates(spark, "x", [])).count() == 0


def test_rerank_replaces_the_score(spark):
    ix = I.build_index(docs(spark, [(1, "Owls hunt at night. Owls hunt mice at night."), (2, BREAD)]))
    q = asked(spark, "Owls hunt mice at dawn.")
    r = R.match_sentences(q, ix, rerank_lexical, 5).first()
    assert r["score_kind"] == "rerank" and r["source"] == 1
    assert r["similarity"] == pytest.approx(66.67, abs=0.01)  # 4 shared words of 6
    model = R.match_sentences(q, ix, lambda c: rerank_model(c, lambda a, b: b.str.len().astype(float)), 5).first()
    assert model["matched_sentence"] == "Owls hunt mice at night."


def test_thresholds(spark):
    m = spark.createDataFrame([(1, 70.0), (2, 70.01), (3, 40.0), (4, 40.5)], "source bigint, similarity double")
    assert [r["severity"] for r in R.flag_matches(m).orderBy("source").collect()] == ["medium", "high", "none", "medium"]
    assert R.above(m, 0.7).count() == 2


def test_sentences_of_hot_terms_only(spark):
    """Every term is hot: few pairs are scored, and the result equals brute force."""
    import random

    rng = random.Random(5)
    words = [f"word{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(2, 5)))) for i in range(300)]
    ix = I.build_index(docs(spark, rows), hot_documents=3, hot_rows=3)
    q = asked(spark, *[" ".join(rng.choices(words, k=3)) for _ in range(12)])
    idf = brute.fit([t for _, t in rows] * 2, 2)
    vectors = [((i, 0), brute.vector(t, idf, 2)) for i, t in rows]
    found = {}
    for r in R.sentence_candidates(R.query_sentences(q), ix, 4).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], (r["source"], r["source_idx"]), round(r["score"], 9)))
    for r in q.collect():
        v = brute.vector(r["text"], idf, 2)
        want = brute.best([(key, brute.dot(v, w)) for key, w in vectors], 4)
        assert sorted(found[r["query_id"]]) == [(n + 1, key, round(x, 9)) for n, (key, x) in enumerate(want)]


def test_index_in_many_parts(spark, monkeypatch):
    """Terms looked up part by part give the same tables as one part, also with long texts and copies across parts."""
    rows = random_corpus(9, 40)
    one = I.build_index(docs(spark, rows), hot_documents=3, hot_rows=3)
    monkeypatch.setattr(V, "PART_CHARS", 150)
    monkeypatch.setattr(V, "LONG_CHARS", 50)
    many = I.build_index(docs(spark, rows), hot_documents=3, hot_rows=3)
    assert V.parts_for(many.documents)[0] > 10 and V.parts_for(many.documents)[1]

    def content(df):
        return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())

    for name in ("vocabulary", "document_weights", "sentence_weights"):
        assert content(one.tables()[name]) == content(many.tables()[name])


def test_postings_stay_where_they_lie(spark):
    """Between the texts and the weights only the texts and the distinct terms of the parts are dealt out."""
    texts = spark.createDataFrame([(0, False, 1, 1, OWL)], "part int, sent boolean, bid long, copies long, text string")
    post = V.postings(texts.repartitionById(3, F.col("part")), ["part", "sent", "bid", "copies"])
    terms = spark.createDataFrame([(0, "owls", 1)], "part int, term string, df long")
    plan = V.attach_by_part(post, terms, 3, False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2  # one of the texts, one of the terms


def test_asked_terms_only_and_whole_documents_move(spark, monkeypatch):
    """Hot postings of terms that no left row has stay where they lie; sentences are not dealt out beside their documents."""
    left = spark.createDataFrame([("q", "a", 0.6, True, 1.0), ("q", "b", 0.8, True, 1.0)], "aid string, term string, w double, hot boolean, hot_norm double")
    right = [(i, t, 0.5, True, 1.0) for i in range(50) for t in ("a", "c", "d", "e")]
    right = M.materialize(spark.createDataFrame(right, "bid long, term string, w double, hot boolean, hot_norm double"), "right")
    found = M.top_matches(left, right, 3, F.col("bid"))
    assert [(r["bid"], round(r["score"], 9), r["rank"]) for r in found.orderBy("rank").collect()] == [(0, 0.3, 1), (1, 0.3, 2), (2, 0.3, 3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= plan.count("Relation [bid") > 0  # every read of the right side is restricted
    dealt = []
    monkeypatch.setattr(I, "postings", lambda df, *args, **named: dealt.append(df) or V.postings(df, *args, **named))
    I.build_index(docs(spark, [(0, OWL)]))
    plan = dealt[0]._jdf.queryExecution().executedPlan().toString()
    assert "sentences-" not in plan


def test_scratch_of_an_index_and_a_search_is_gone(spark):
    folder = shared_dir(spark)
    before = set(os.listdir(folder))
    corpus = spark.createDataFrame([(i, f"one two three. four {i} five six. one two {i % 3}.") for i in range(40)], "doc_id long, text string")
    ix = I.build_index(corpus, hot_documents=2, hot_rows=2)
    a = ix.document_weights.withColumnRenamed("bid", "aid")
    assert M.top_matches(a, ix.document_weights, 3, F.col("bid")).count() == 120
    left = {name.rpartition("-")[0] for name in set(os.listdir(folder)) - before}
    assert "weights" in left and not left & {"partterms", "cold"}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"


def test_texts_under_one_key_share_a_norm(spark):
    """Rows that repeat an id are one vector of the index."""
    corpus = spark.createDataFrame([(1, "alpha beta"), (1, "alpha beta"), (2, "alpha gamma")], "doc_id long, text string")
    squares = I.build_index(corpus).document_weights.groupBy("bid.doc_id").agg(F.sum(F.col("w") * F.col("w")).alias("s"))
    assert {r["doc_id"]: r["s"] for r in squares.collect()} == {1: pytest.approx(1.0), 2: pytest.approx(1.0)}
