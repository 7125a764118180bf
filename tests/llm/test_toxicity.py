import random

import numpy as np
import pytest
from helpers import docs, folder

from copytrace.llm import toxicity

BAD = ["vilezor", "vilemak", "grubnik", "snorfle"]


def table(n, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(["ba", "lo", "ne", "ti", "ru", "ka"], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 80))]
        toxic = i % 4 == 0
        for _ in range(rng.randint(1, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "!", ","]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_grades_follow_the_labels(spark, tmp_path):
    rows, labels = table(600)
    known = [x for x in labels if x[0] < 400] + [(5000, 1, 1), (None, 0, 1), (3, 1, None), labels[0], labels[1]]
    odd = [(9001, None), (9002, ""), (9003, "VILEZOR!! ba"), (9004, "ba lo ne " * 60_000 + "grubnik"), (1, rows[1][1])]
    path = folder(tmp_path, spark, documents=docs(spark, rows + odd), labels=spark.createDataFrame(known, LABELS))
    found = toxicity.op9_toxicity(spark, path).collect()
    assert len(found) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in found}
    unseen = [x for x in labels if x[0] >= 400]
    assert np.mean([by_id[i].toxic == bool(t) for i, _, t in unseen]) > 0.98
    assert all(0 <= r.severity <= 3 and r.toxic == (r.grade > 0) for r in found)
    assert by_id[9003].toxic and not by_id[9001].toxic and not by_id[9002].toxic
    toxic = [(sum(w.strip("!,") in BAD for w in t.split()), by_id[i].severity) for i, t in rows if i >= 400 and i % 4 == 0]
    few, many = [s for n, s in toxic if n <= 2], [s for n, s in toxic if n >= 5]
    assert np.mean(many) > np.mean(few) + 0.5


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(1, 0, 1)]])
def test_without_both_labels(spark, tmp_path, labels):
    rows = [(1, "a b"), (2, "c d")]
    path = folder(tmp_path, spark, documents=docs(spark, rows), labels=spark.createDataFrame(labels, LABELS))
    assert [(r.severity, r.toxic) for r in toxicity.op9_toxicity(spark, path).collect()] == [(0.0, False)] * 2


def test_empty_table(spark, tmp_path):
    path = folder(tmp_path, spark, documents=docs(spark, []), labels=spark.createDataFrame([(1, 1, 1)], LABELS))
    assert toxicity.op9_toxicity(spark, path).count() == 0


def test_thresholds_are_ordered_and_the_likelihood_is_at_its_peak():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    grade = np.clip(np.digitize(x @ [2.0, -1.0] + rng.logistic(size=400), [-1, 0.5, 2]), 0, 3)
    weight = np.full(400, 1 / 400)
    w, theta = toxicity.fit_ordinal(x, grade, weight)
    assert (np.diff(theta) > 0).all() and np.allclose(w, [2, -1], atol=0.5)

    def loss(w, theta):
        edge = np.concatenate(([-np.inf], theta, [np.inf]))
        above = 1 / (1 + np.exp(edge[None, :] - (x @ w)[:, None]))
        return -np.log(above[np.arange(400), grade] - above[np.arange(400), grade + 1]).mean() + 5e-5 * w @ w

    here = loss(w, theta)
    for k in range(5):
        for move in (-0.05, 0.05):
            step = np.eye(5)[k] * move
            assert loss(w + step[:2], theta + step[2:]) > here - 1e-6


def plain_words(text):
    """Distinct features of every token of a text, by plain rules."""
    out = []
    for token in text.split():
        letters = [i for i, c in enumerate(token) if c.isalpha()]
        word = token[letters[0] : letters[-1] + 1].lower() if letters else ""
        out.append({"^" + word[:n] for n in (3, 4, 5, 6) if n < len(word)} | {f"^{word}$"} if word else set())
    return out


def test_marks_scores_and_rows_by_brute_force(spark, tmp_path):
    rows, labels = table(300, seed=5)
    # A mark longer than any usual word, and an id with many texts.
    long = "z" * 90
    rows = [(i, t + (f" {long}." if i % 8 == 0 else "")) for i, t in rows] + [(2, f"again {k} ti ru") for k in range(40)]
    known = [x for x in labels if x[0] < 200]
    d = spark.createDataFrame(rows, "id long, text string")
    y = spark.createDataFrame([(i, t) for i, _, t in known], "id long, toxic int")
    model = toxicity.learn(d, y)
    of = {i: t for i, _, t in known}
    sample = [(set().union(*plain_words(t)), of[i]) for i, t in set(rows) if i in of]
    n = [sum(1 for _, t in sample if t == k) for k in (0, 1)]
    want = set()
    for f in set().union(*(s for s, _ in sample)):
        rate = [sum(f in s for s, t in sample if t == k) / n[k] for k in (0, 1)]
        p = (rate[0] * n[0] + rate[1] * n[1]) / sum(n)
        z = (rate[1] - rate[0]) / ((p * (1 - p) * (1 / n[0] + 1 / n[1])) ** 0.5 + 1e-12)
        if z >= 5 and rate[1] >= 8 * rate[0]:
            want.add(f)
    assert set(model.names) == want and f"^{long}$" in want
    m = len(want)
    found = toxicity.predict(d, model).collect()
    assert len(found) == len(rows)
    got = sorted((r.id, tuple(round(p, 9) for p in r.at_least)) for r in found)
    expected = []
    for i, text in rows:
        words = plain_words(text)
        score = 0.0
        for f, at in model.names.items():
            distinct = {max(w, key=lambda g: (g.endswith("$"), g)) for w in words if f in w}
            total = sum(f in w for w in words)
            if total:
                share = toxicity.PER_WORDS / (len(words) + toxicity.PER_WORDS)
                score += model.weights[at] * np.log1p(len(distinct)) + model.weights[at + m] * np.log1p(total * share)
        expected.append((i, tuple(round(float(1 / (1 + np.exp(t - score))), 9) for t in model.thresholds)))
    assert got == sorted(expected)


def test_extent_counts_segments():
    marks = frozenset({"^vil"})
    assert toxicity.extent("", marks) == 0 and toxicity.extent("a b vilezor vilemak", marks) == 1
    assert toxicity.extent(" ".join(["vilezor"] + ["a"] * 7 + ["(Vilemak)"] + ["b"] * 30), marks) == 2


def test_rows_of_the_fit_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PER_LABEL", 20)
    d = spark.createDataFrame([(1, f"clean text {i}") for i in range(100)] + [(2, f"vilezor {i}") for i in range(100)], "id long, text string")
    known = spark.createDataFrame([(1, 0), (2, 1)], "id long, toxic int")
    assert sorted(r["count"] for r in toxicity._sample(d, known).groupBy("toxic").count().collect()) == [20, 20]
