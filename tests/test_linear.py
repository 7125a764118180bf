import numpy as np
import pytest
from pyspark.sql import functions as F

from copytrace.operators import linear, train
from copytrace.session import new_path

WORDS = "alpha beta gamma delta omega sigma kappa theta zeta".split()


def rows(spark, n=60, seed=3):
    rng = np.random.default_rng(seed)
    made = []
    for i in range(n):
        label = i % 3 == 0
        share = np.array([3.0 if (j < 4) == label else 1.0 for j in range(len(WORDS))])
        words = rng.choice(WORDS, rng.integers(0, 9), p=share / share.sum())
        made.append((f"r{i}", " ".join([*words, f"own{i}"]), "ai" if label else "human"))
    return spark.createDataFrame(made, "row_id string, text string, label string")


def dense(texts, y, weight, max_df=0.95):
    """Terms, idf, weights and intercept by Newton's method on the dense matrix."""
    grams = []
    for t in texts:
        toks = [w for w in t.lower().split() if len(w) > 1]
        grams.append([*toks, *map(" ".join, zip(toks, toks[1:]))])
    df = {}
    for g in grams:
        for term in set(g):
            df[term] = df.get(term, 0) + 1
    terms = sorted(t for t, d in df.items() if d <= max_df * len(texts))
    idf = np.array([np.log((1 + len(texts)) / (1 + df[t])) + 1 for t in terms])
    x = np.array([[g.count(t) for t in terms] for g in grams]) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    z, ridge, at = np.hstack([x, np.ones((len(x), 1))]), np.diag([1.0] * x.shape[1] + [0.0]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ at))
        at -= np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + ridge, z.T @ (weight * (p - y)) + ridge @ at)
    return dict(zip(terms, zip(idf, at))), at[-1], x


def test_weights_are_the_dense_optimum(spark):
    given = rows(spark)
    model = train.fit_classifier(given)
    weighted = train.balanced_weights(given).collect()
    y, w = np.array([r["label"] == "ai" for r in weighted], float), np.array([r["weight"] for r in weighted])
    want, intercept, _ = dense([r["text"] for r in weighted], y, w)
    got = {r["term"]: (r["idf"], r["weight"]) for r in model.terms.collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[t][1] - want[t][1]) for t in want) < 1e-6 and model.intercept == pytest.approx(intercept, abs=1e-6)
    assert all(got[t][0] == pytest.approx(want[t][0]) for t in want) and model.gradient_norm <= 5e-7


def test_saved_model_scores_alike(spark):
    given = rows(spark)
    path = new_path(spark, "terms")
    assert linear.load_terms(spark, path) is None
    model = train.ship_classifier(given, path)
    loaded = linear.load_terms(spark, path)
    assert (loaded.intercept, loaded.gradient_norm) == (model.intercept, model.gradient_norm)
    texts = spark.createDataFrame([("alpha beta", 1), ("unseen words", 2), ("", 3), (None, 4), ("alpha beta", 1)], "text string, term int")
    scored = {(r["text"], r["term"]): r["ai_probability"] for r in loaded.transform(texts).collect()}
    base = 1 / (1 + np.exp(-model.intercept))
    assert scored["", 3] == scored[None, 4] == scored["unseen words", 2] == pytest.approx(base)
    weights = {r["term"]: r["idf"] * r["weight"] for r in model.terms.collect()}
    idf = {r["term"]: r["idf"] for r in model.terms.collect()}
    known = [t for t in ("alpha", "beta", "alpha beta") if t in idf]
    margin = sum(weights[t] for t in known) / np.sqrt(sum(idf[t] ** 2 for t in known)) + model.intercept
    assert scored["alpha beta", 1] == pytest.approx(1 / (1 + np.exp(-margin)))
    assert loaded.transform(texts).count() == 5


def test_same_result_as_the_spark_ml_pipeline(spark):
    given = rows(spark, 45)
    ours = train.predict(train.fit_classifier(given), given).select("row_id", F.col("ai_probability").alias("p"))
    theirs = train.predict(train.train_classifier(given), given).select("row_id", F.col("ai_probability").alias("q"))
    assert ours.join(theirs, "row_id").agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-3


def test_one_class_no_terms_and_no_rows(spark):
    one = spark.createDataFrame([("a", "x y", "ai"), ("b", "", "ai")], "row_id string, text string, label string")
    model = train.fit_classifier(one, max_iter=50)
    assert model.transform(one).agg(F.min("ai_probability")).first()[0] > 0.9
    empty = train.fit_classifier(one.limit(0))
    assert empty.terms.count() == 0 and empty.transform(one).select("ai_probability").distinct().collect()[0][0] == 0.5


def test_minimiser_on_a_known_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 90))
    y, weight = (rng.random(40) < 0.3).astype(float), rng.random(40) + 0.5
    a, b, norm = linear.minimise(lambda v: x @ (x.T @ v), y, weight, 1.0, 1e-9, 500)
    w = x.T @ a
    r = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
    assert norm <= 1e-9 and np.abs(x.T @ r + w).max() < 1e-8 and abs(r.sum()) < 1e-8


def test_products_come_in_blocks(spark, monkeypatch):
    """X X'v is summed up on the executors in blocks of packed numbers and equals the dense product."""
    given = rows(spark, 45)
    monkeypatch.setattr(linear, "BLOCK", 16)
    numbers = linear.numbered(given.select("text"), "id", "rows")
    _, weights = linear.term_features(numbers, 45, 0.95)
    x = np.zeros((45, 1000))
    known = weights.collect()
    place = {t: i for i, t in enumerate(sorted({r["term"] for r in known}))}
    for r in known:
        x[r["id"], place[r["term"]]] = r["w"]
    kernel, v = linear.Kernel(weights, 45), np.random.default_rng(2).normal(size=45)
    assert sorted((r["block"], len(r["v"])) for r in kernel.sums(spark.sparkContext.broadcast(v)).collect()) == [(0, 128), (1, 128), (2, 104)]
    assert np.abs(kernel(v) - x @ (x.T @ v)).max() < 1e-9


def test_a_fit_reads_all_rows(spark, monkeypatch):
    given = rows(spark, 45)

    def cut(labelled, *_):
        raise AssertionError("rows were left out")

    monkeypatch.setattr(train, "bounded_rows", cut)
    model = train.fit_classifier(given, 1.0)
    own = model.terms.filter(F.col("term").startswith("own") & (F.col("df") == 1)).count()
    assert own == 45 and "max_rows" not in train.fit_classifier.__code__.co_varnames
    train.train_classifier(given)


def test_postings_of_a_fit_move_once(spark):
    """Texts are dealt into parts; of their terms only the distinct ones of a part move, and a part is never cut."""
    given = rows(spark, 45)
    numbers = linear.numbered(given.select("text"), "id", "rows")
    terms, weights = linear.term_features(numbers, 45, 1.0)
    assert weights.columns == ["id", "term", "df", "idf", "w", "hot_norm"]
    assert weights.groupBy("term").agg(F.count("*").alias("n"), F.first("df").alias("df")).filter("n != df").isEmpty()
    assert terms.count() == weights.select("term").distinct().count()
    model = spark.createDataFrame([("alpha", 2, 1.5, 0.25), ("beta", 1, 2.0, -1.0)], "term string, df long, idf double, weight double")
    texts = spark.createDataFrame([(0, "alpha alpha beta"), (1, "unseen"), (2, None)], "id long, text string")
    plan = linear.margins(texts, model, "id")
    assert {r["id"]: r["margin"] for r in plan.collect()} == {0: pytest.approx((3 * 0.25 - 2.0) / np.sqrt(9 + 4))}
