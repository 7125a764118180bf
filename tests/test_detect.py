import numpy as np
import pytest
from pyspark.sql import functions as F

from copytrace.operators import calibrate, detect, evaluate, split, train
from copytrace.session import new_path

UNIFORM = " ".join(f"The committee will review the annual budget plan with great care every {d}." for d in ("spring", "summer", "autumn", "winter"))
VARIED = "Rain. Nobody in the whole quiet valley had expected a storm like that one to arrive before harvest time. We ran home fast, laughing."


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")


def test_heuristic(spark):
    rows = detect.detect_heuristic(texts(spark, UNIFORM, VARIED, ""), keep_stats=True).orderBy("doc_id").collect()
    assert rows[0]["ai_probability"] > rows[1]["ai_probability"]
    assert (rows[2]["ai_probability"], rows[2]["label"]) == (1.0, "AI")  # blank text
    for r in rows:
        assert r["backend"] == "heuristic"
        assert r["ai_probability"] + r["human_probability"] == pytest.approx(1.0, abs=1e-4)
        assert (r["label"] == "AI") == (r["ai_probability"] >= 0.5)
    assert rows[0]["burstiness"] == 0.0 and rows[0]["confidence"] == round(abs(rows[0]["ai_probability"] - 0.5) * 2, 4)


def test_reasons(spark):
    rows = {r["doc_id"]: r for r in detect.explain_signals(texts(spark, UNIFORM, VARIED, "Hi.")).collect()}
    assert [e.split(" ")[0] for e in rows[0]["explanation"]] == ["low", "highly", "repetitive"]
    assert rows[0]["explanation"][0].startswith("low lexical diversity (0.29, ")  # 15 of 52 words
    assert rows[0]["repeated"] == 4
    assert rows[0]["explanation"][2] == "repetitive phrasing detected in 4 sentence(s)"
    assert rows[1]["explanation"] == []
    assert rows[2]["explanation"] == [
        "highly uniform sentence structure (sentence-length variance is 0.00, unusually low)"
    ]


def test_logits_and_fallback(spark):
    logits = spark.createDataFrame([(0, [2.0, 0.0]), (1, [0.0, 3.0])], "doc_id bigint, logits array<double>")
    rows = detect.detect_from_logits(logits, ["Fake", "Real"], 2.0, model="org/net").orderBy("doc_id").collect()
    assert rows[0]["ai_probability"] == 0.7311 and rows[0]["label"] == "AI" and rows[0]["backend"] == "transformer"
    assert rows[0]["reason"] == "transformer classifier (net) predicts AI-generated with 73.1% probability"
    assert rows[1]["human_probability"] == 0.8176 and rows[1]["label"] == "Human"
    with pytest.raises(ValueError):
        detect.detect_from_logits(logits, ["LABEL_0", "LABEL_1"])
    scored = detect.detect_from_logits(logits.filter("doc_id = 0"), ["Fake", "Real"])
    both = detect.with_fallback(scored, texts(spark, UNIFORM, VARIED), ["doc_id"]).orderBy("doc_id").collect()
    assert [r["backend"] for r in both] == ["transformer", "heuristic"]


def test_backend_choice():
    assert detect.choose_backend("auto", False) == "heuristic"
    assert detect.choose_backend("auto", True, True) == "classifier"
    assert detect.choose_backend("transformer", True, False) == "classifier"
    assert detect.choose_backend("transformer", False, True) == "transformer"
    assert detect.choose_backend("classifier", False) == "heuristic"
    assert detect.choose_backend("something", True) == "heuristic"


def labelled(spark, n=12):
    rows = [(f"h{i}", f"honestly lol that game {i} was so bad we left early", "human") for i in range(n)]
    rows += [(f"a{i}", f"furthermore the aforementioned approach {i} demonstrates significant benefits", "ai") for i in range(n)]
    return spark.createDataFrame(rows, "row_id string, text string, label string")


def test_classifier_round_trip(spark):
    path = new_path(spark, "clf")
    assert train.load_classifier(spark, path) is None
    train.ship_classifier(labelled(spark), path)
    model = train.load_classifier(spark, path)
    df = spark.createDataFrame(
        [(0, "furthermore the approach demonstrates benefits"), (1, "lol that was so bad"), (2, None)], "doc_id bigint, text string"
    )
    rows = detect.detect_classifier(df, model).orderBy("doc_id").collect()
    assert [r["label"] for r in rows] == ["AI", "Human", None]
    assert rows[0]["backend"] == "classifier" and rows[2]["ai_probability"] is None
    filled = detect.with_fallback(detect.detect_classifier(df, model), df, ["doc_id"]).orderBy("doc_id").collect()
    assert [r["backend"] for r in filled] == ["classifier", "classifier", "heuristic"]


def test_features_are_all_terms(spark):
    rows = labelled(spark)
    grams = set()
    for r in rows.collect():
        toks = [t for t in r["text"].split() if len(t) > 1]
        grams |= {*toks, *map(" ".join, zip(toks, toks[1:]))}
    assert set(train.fit_features(rows, 1.0).stages[3].vocabulary) == grams


def test_bounded_rows(spark):
    rows = spark.range(4000).selectExpr("id AS row_id")
    assert train.bounded_rows(rows, 4000).count() == 4000
    assert 800 < train.bounded_rows(rows, 1000).count() < 1200


def test_fit_is_the_optimum(spark):
    """Weights against a dense solution of the same penalised loss."""
    rows = labelled(spark, 20).union(spark.createDataFrame([("x", "honestly the approach demonstrates lol", "human"), ("y", "that game was significant", "ai")], "row_id string, text string, label string"))
    model = train.train_classifier(rows)
    prepared = train.balanced_weights(rows).withColumn("target", (F.col("label") == "ai").cast("double"))
    data = train.PipelineModel(stages=model.stages[:-1]).transform(prepared).collect()
    x = np.array([r["features"].toArray() for r in data])
    y, w = np.array([r["target"] for r in data]), np.array([r["weight"] for r in data])
    coef, bias, lam = np.zeros(x.shape[1]), 0.0, 1.0 / len(x)
    for _ in range(60):  # Newton
        p = 1 / (1 + np.exp(-(x @ coef + bias)))
        z = np.hstack([x, np.ones((len(x), 1))])
        ridge = np.diag([lam] * x.shape[1] + [0.0])
        grad = z.T @ (w * (p - y)) / w.sum() + ridge @ np.append(coef, bias)
        step = np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) / w.sum() + ridge + 1e-12 * np.eye(len(ridge)), grad)
        coef, bias = coef - step[:-1], bias - step[-1]
    assert model.stages[-1].coefficients.toArray() == pytest.approx(coef, abs=2e-3)
    assert model.stages[-1].intercept == pytest.approx(bias, abs=2e-3)


def test_evaluation_report(spark):
    r = train.evaluate_classifier(labelled(spark), "toy").first()
    assert (r["train_size"], r["test_size"]) == (19, 5)
    assert r["accuracy"] == 1.0 and r["roc_auc"] == 1.0
    assert sum(map(sum, r["confusion_matrix"])) == 5 and r["labels"] == ["ai", "human"]


def test_metrics_by_hand(spark):
    rows = [("ai", "ai")] * 3 + [("ai", "human")] + [("human", "ai")] * 2 + [("human", "human")] * 4
    m = evaluate.binary_metrics(spark.createDataFrame(rows, "label string, predicted string")).first()
    assert (m["n"], m["accuracy"], m["precision"], m["recall"], m["f1"]) == (10, 0.7, 0.6, 0.75, 0.6667)
    cm = {r["label"]: (r["pred_ai"], r["pred_human"]) for r in evaluate.confusion_matrix(spark.createDataFrame(rows, "label string, predicted string")).collect()}
    assert cm == {"ai": (3, 1), "human": (2, 4)}


@pytest.mark.parametrize("distinct", [3, 500])
def test_auc_equals_pair_count(spark, distinct):
    import random

    rng = random.Random(distinct)
    rows = [(rng.randrange(distinct) / distinct, rng.choice(["ai", "human"])) for _ in range(400)]
    pos = [s for s, y in rows if y == "ai"]
    neg = [s for s, y in rows if y == "human"]
    wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    got = evaluate.roc_auc(spark.createDataFrame(rows, "s double, label string"), "s").first()["roc_auc"]
    assert got == pytest.approx(wins / len(pos) / len(neg), abs=1e-4)


def test_stratified_split(spark):
    df = spark.range(101).select(F.col("id"), F.when(F.col("id") < 33, "a").otherwise("b").alias("label"))
    rows = split.stratified_split(df, ["id"]).collect()
    test = [r for r in rows if r["split"] == "test"]
    assert len(rows) == 101 and len(test) == 21  # ceil(20.2)
    assert sum(r["label"] == "a" for r in test) == 7
    chunks = [split.shuffled_chunk(df, ["id"], i, 40).collect() for i in range(3)]
    assert [len(c) for c in chunks] == [40, 40, 21]
    assert len({r["id"] for c in chunks for r in c}) == 101


def synthetic_logits(spark, n, right, size):
    rows = []
    for i in range(n):
        truth = i % 2
        shown = truth if i % 100 < right else 1 - truth
        rows.append(([size if shown == 0 else -size, size if shown == 1 else -size], truth))
    return spark.createDataFrame(rows, "logits array<double>, true_index int")


def test_temperature(spark):
    import math

    over = synthetic_logits(spark, 200, 70, 8.0)
    assert calibrate.fit_temperature(over) == 10.0  # the optimum lies beyond the bound
    half = math.log(0.8 / 0.2) / 2
    fair = synthetic_logits(spark, 500, 80, half)
    assert calibrate.fit_temperature(fair) == pytest.approx(1.0, abs=1e-4)
    mid = synthetic_logits(spark, 500, 80, 3 * half)
    t = calibrate.fit_temperature(mid)
    grid = [2.5 + i / 100 for i in range(100)]
    curve = {r["temperature"]: r["nll"] for r in evaluate.nll_curve(mid, grid).collect()}
    assert t == pytest.approx(min(curve, key=curve.get), abs=0.011)
    path = new_path(spark, "t")
    assert calibrate.read_temperature(spark, path) == 1.0
    report = calibrate.calibration_report(mid, "m", "d")
    calibrate.write_report(report, path)
    assert calibrate.read_temperature(spark, path) == pytest.approx(t)
    assert report.first()["nll_after"] < report.first()["nll_before"]


def test_one_entry_for_all_backends(spark):
    df = texts(spark, UNIFORM, VARIED, None)
    plain = {r["doc_id"]: r for r in detect.detect(df, "transformer").collect()}  # nothing else at hand
    assert {r["backend"] for r in plain.values()} == {"heuristic"} and len(plain[0]["explanation"]) == 3
    logits = spark.createDataFrame([(0, [2.0, 0.0])], "doc_id bigint, logits array<double>")
    found = {r["doc_id"]: r for r in detect.detect(df, "transformer", logits=logits, labels=["Fake", "Real"], temperature=2.0, model="org/net").collect()}
    assert [found[i]["backend"] for i in range(3)] == ["transformer", "heuristic", "heuristic"]
    assert found[0]["explanation"][:3] == plain[0]["explanation"]
    assert found[0]["explanation"][3] == "transformer classifier (net) predicts AI-generated with 73.1% probability"
    assert found[1]["explanation"] == plain[1]["explanation"] and found[1]["ai_probability"] == plain[1]["ai_probability"]
    model = train.train_classifier(labelled(spark))
    scored = {r["doc_id"]: r for r in detect.detect(df.withColumnRenamed("doc_id", "name"), "auto", key="name", classifier=model).withColumnRenamed("name", "doc_id").collect()}
    assert [scored[i]["backend"] for i in range(3)] == ["classifier", "classifier", "heuristic"]
    assert scored[0]["explanation"] == plain[0]["explanation"]


def test_label_positions():
    assert detect.label_positions(["Real", "Fake"]) == (1, 0)
    assert detect.label_positions(["Human-written", "Machine", "other"]) == (1, 0)
    for bad in (["LABEL_0", "LABEL_1"], ["ai", "ai"], []):
        with pytest.raises(ValueError):
            detect.label_positions(bad)
