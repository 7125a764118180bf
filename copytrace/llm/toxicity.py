"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features of a text: the distinct words' prefixes of three to six letters and
whole words, of any length, kept if they mark toxic texts in the fitting
sample: a two-sample z of at least ``LEAST_Z`` and ``LEAST_LIFT`` times the rate
of clean texts. All that pass are kept.

Grades: 0 for texts labelled clean; texts labelled toxic are graded 1 to 3 by
the thirds of their extent, the number of ``SEGMENT``-word segments that hold a
mark found in the other half of the sample, so that no text is graded by marks
it helped to choose. The model is one weight vector
shared by all thresholds: P(grade >= k) = sigmoid(w x - theta_k) with
theta_1 < theta_2 < theta_3, fitted by maximum likelihood. A text's severity
is its expected grade, the sum of P(grade >= k); it is toxic if P(grade >= 1)
is at least 1/2.

The fit reads at most ``PER_LABEL`` rows of either label (the first by a hash
of id and text), a bounded and documented sample, also where an id has many
texts. The driver sees the sample's kept features only, as sparse rows.
Everything else covers all rows and whole texts.

Defined cases: a null or empty text has no features and the grade such a text
implies; without labels of both kinds everything has severity 0; label rows
that repeat count once, contradicting labels count as toxic; labels without a
document or a value are ignored; equal rows get equal answers; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copytrace.llm.common import documents, spread, text_of
from copytrace.session import materialize
from copytrace.sources.tables import read_table

PER_LABEL = 3000
LEAST_Z = 5.0
LEAST_LIFT = 8.0
GRADES = 4
PREFIXES = (3, 4, 5, 6)
CACHE_WORDS = 300_000
STEPS = 400
PER_WORDS = 50
SEGMENT = 8


def features_of(token: str) -> list[str]:
    """Prefixes and the whole of a token's word: its letters, outer marks stripped, lower-cased."""
    start, stop = 0, len(token)
    while start < stop and not token[start].isalpha():
        start += 1
    while stop > start and not token[stop - 1].isalpha():
        stop -= 1
    word = token[start:stop].lower()
    if not word:
        return []
    return [*(f"^{word[:n]}" for n in PREFIXES if n < len(word)), f"^{word}$"]


@dataclass
class Model:
    names: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self):
        self.cache: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def values(self, text: str) -> dict[int, float]:
        """Number to value: for each feature its distinct words, and, from ``len(names)`` on, its share of all words."""
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        cache, names = self.cache, self.names
        distinct: Counter[int] = Counter()
        total: Counter[int] = Counter()
        seen = set()
        tokens = text.split()
        for token, n in Counter(tokens).items():
            found = cache.get(token)
            if found is None:
                found = cache[token] = tuple(names[f] for f in features_of(token) if f in names)
            if found:
                total.update(dict.fromkeys(found, n))
                if (word := features_of(token)[-1]) not in seen:
                    seen.add(word)
                    distinct.update(found)
        share = PER_WORDS / (len(tokens) + PER_WORDS)
        return {i: float(np.log1p(n)) for i, n in distinct.items()} | {i + len(names): float(np.log1p(n * share)) for i, n in total.items()}

    def at_least(self, text: str) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        score = sum(self.weights[i] * x for i, x in self.values(text).items())
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds - score, -700, 700)))


@dataclass
class Rows:
    """A sparse matrix by its cells."""

    shape: tuple[int, int]
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Rows:
        row, column = np.nonzero(x)
        return Rows(x.shape, row, column, x[row, column])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.shape[0])

    def sums(self, g: np.ndarray) -> np.ndarray:
        """Transposed matrix times ``g``."""
        return np.bincount(self.column, self.value * g[self.row], self.shape[1])


def fit_ordinal(x: np.ndarray | Rows, grade: np.ndarray, weight: np.ndarray, grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of greatest likelihood (with a small ridge), by adaptive gradient steps.

    theta_1 is free and the gaps are exponentials, so the order holds throughout.
    """
    if isinstance(x, np.ndarray):
        x = Rows.of(x)
    n, m = x.shape
    params = np.concatenate((np.zeros(m), [1.0], np.zeros(grades - 2)))
    first, second = np.zeros_like(params), np.zeros_like(params)
    rows = np.arange(n)
    weight = weight / weight.sum()
    for step in range(1, STEPS + 1):
        w, gaps = params[:m], np.exp(params[m + 1 :])
        theta = np.concatenate(([-np.inf], params[m] + np.concatenate(([0.0], np.cumsum(gaps))), [np.inf]))
        with np.errstate(over="ignore"):
            above = 1.0 / (1.0 + np.exp(theta[None, :] - x.times(w)[:, None]))  # P(grade >= k), k = 0 .. grades
        hit = np.maximum(above[rows, grade] - above[rows, grade + 1], 1e-12)
        slope = above * (1 - above)
        low, high = weight * slope[rows, grade] / hit, weight * slope[rows, grade + 1] / hit
        d_theta = np.bincount(grade, low, grades + 1) - np.bincount(grade + 1, high, grades + 1)
        d_gap = np.array([d_theta[k:grades].sum() for k in range(2, grades)]) * gaps
        grad = np.concatenate((-x.sums(low - high) + 1e-4 * w, [d_theta[1:grades].sum()], d_gap))
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        params = params - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return params[:m], params[m] + np.concatenate(([0.0], np.cumsum(np.exp(params[m + 1 :]))))


# Texts that hold a feature, by label and half of the sample.
COUNTS = ("clean0", "clean1", "toxic0", "toxic1")


def _presence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts per feature, label and half, added up within a task."""
    counts: dict[str, Counter] = {c: Counter() for c in COUNTS}
    for batch in batches:
        for text, toxic, half in zip(batch.text, batch.toxic, batch.half):
            counts[COUNTS[2 * int(toxic) + int(half)]].update({f for token in set(text.split()) for f in features_of(token)})
    names = list(set().union(*counts.values()))
    for at in range(0, len(names), 20_000):
        part = names[at : at + 20_000]
        yield pd.DataFrame({"name": part} | {c: [counts[c][f] for f in part] for c in COUNTS})


def _marks(clean: Column, toxic: Column, n_clean: float, n_toxic: float) -> Column:
    """Whether a feature held by so many texts of either label marks toxic ones."""
    if not n_clean or not n_toxic:
        return F.lit(False)
    both = (clean + toxic) / (n_clean + n_toxic)
    deviation = F.sqrt(both * (1 - both) * (1 / n_clean + 1 / n_toxic)) + 1e-12
    more = (toxic / n_toxic - clean / n_clean) / deviation >= LEAST_Z
    return more & (toxic / n_toxic >= LEAST_LIFT * clean / n_clean)


def extent(text: str, marks: frozenset[str]) -> int:
    """Segments of ``SEGMENT`` words that hold a marked word."""
    marked = [i // SEGMENT for i, token in enumerate(text.split()) if not marks.isdisjoint(features_of(token))]
    return len(set(marked))


def _sample(docs: DataFrame, known: DataFrame) -> DataFrame:
    """id, mark, text, toxic, half of the rows the fit reads."""
    parts = [known.where(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(PER_LABEL) for label in (0, 1)]
    # At most 2 x PER_LABEL ids.
    found = docs.join(F.broadcast(parts[0].union(parts[1])), "id")
    found = found.select("id", text_of("text").alias("text"), F.col("toxic").cast("int")).withColumn("mark", F.xxhash64("text"))
    found = materialize(found.dropDuplicates(["id", "mark"]), "toxicity-found")
    # An id may have many texts: rows are bounded too.
    by_hash = (F.xxhash64("id", "mark"), F.col("id"), F.col("mark"))
    keys = [found.where(F.col("toxic") == label).select("id", "mark").orderBy(*by_hash).limit(PER_LABEL) for label in (0, 1)]
    rows = found.join(F.broadcast(keys[0].union(keys[1])), ["id", "mark"])
    return materialize(rows.withColumn("half", F.pmod(F.xxhash64("mark", "id"), F.lit(2)).cast("int")), "toxicity-sample")


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on ``docs(id, text)`` and ``labels(id, toxic 0/1)``; None unless there are labels of both kinds."""
    known = labels.where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("id").distinct(), "id", "left_semi")
    known = materialize(known, "toxicity-labels")
    of = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    sample = _sample(docs, known)
    sizes = {c: 0.0 for c in COUNTS}
    for r in sample.groupBy("toxic", "half").agg(F.count(F.lit(1)).alias("n")).collect():  # four rows
        sizes[COUNTS[2 * r.toxic + r.half]] = float(r.n)
    clean, toxic = sizes["clean0"] + sizes["clean1"], sizes["toxic0"] + sizes["toxic1"]
    if not clean or not toxic:
        return None
    seen = sample.select("text", "toxic", "half").mapInPandas(_presence, "name string, " + ", ".join(f"{c} long" for c in COUNTS))
    seen = seen.groupBy("name").agg(*[F.sum(c).alias(c) for c in COUNTS])
    by_half = [_marks(F.col(f"clean{h}"), F.col(f"toxic{h}"), sizes[f"clean{h}"], sizes[f"toxic{h}"]) for h in (0, 1)]
    both = _marks(F.col("clean0") + F.col("clean1"), F.col("toxic0") + F.col("toxic1"), clean, toxic)
    kept = seen.select("name", both.alias("both"), *[m.alias(f"half{h}") for h, m in enumerate(by_half)])
    kept = kept.where("both OR half0 OR half1").orderBy("name").toPandas()  # what marks toxic texts of the sample
    names = {f: i for i, f in enumerate(kept.name[kept.both])}
    # A text is graded by the marks of the other half.
    others = [frozenset(kept.name[kept[f"half{1 - h}"]]) for h in (0, 1)]
    model = Model(names, np.zeros(2 * len(names)), np.zeros(GRADES - 1))

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [model.values(t) for t in batch.text]
            extents = [extent(t, others[h]) for t, h in zip(batch.text, batch.half)]
            yield pd.DataFrame(
                {"id": batch.id.astype(str), "mark": batch.mark, "toxic": batch.toxic, "extent": extents}
                | {"at": [list(v) for v in values], "x": [list(v.values()) for v in values]}
            )

    schema = "id string, mark long, toxic int, extent long, at array<int>, x array<double>"
    rows = sample.mapInPandas(sparse, schema).toPandas().sort_values(["id", "mark"], ignore_index=True)
    at = [np.asarray(v, np.int64) for v in rows["at"]]
    x = Rows(
        (len(rows), 2 * len(names)),
        np.repeat(np.arange(len(rows)), [len(v) for v in at]),
        np.concatenate(at),
        np.concatenate([np.asarray(v, float) for v in rows.x]),
    )
    label, extents = rows.toxic.to_numpy(), rows.extent.to_numpy()
    thirds = np.quantile(extents[label == 1], [1 / 3, 2 / 3])
    grade = np.where(label == 1, 1 + np.searchsorted(thirds, extents, side="left"), 0)
    # The sample stands for all labels in their true proportion.
    weight = np.where(label == 1, of[1] / toxic, of[0] / clean)
    model.weights, model.thresholds = fit_ordinal(x, grade, weight)
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(id, at_least) of ``docs(id, text)``: P(grade >= k) for k from 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the weights of a bounded sample's marks

    @F.pandas_udf("array<double>")
    def decide(texts: pd.Series) -> pd.Series:
        known = shared.value
        none = np.zeros(GRADES - 1)
        return pd.Series([none if known is None else known.at_least(t) for t in texts])

    return docs.select("id", decide(text_of("text")).alias("at_least"))


def severity(at_least: Column) -> Column:
    """Expected grade."""
    return F.aggregate(at_least, F.lit(0.0), lambda a, b: a + b)


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, severity (expected grade), grade (median of the grade) and toxic of every document."""
    docs = documents(spark, folder).select(F.col("doc_id").alias("id"), "text")
    labels = read_table(spark, folder, "labels").select(F.col("doc_id").alias("id"), "toxic")
    found = predict(spread(docs, "id"), learn(docs, labels))
    passed = F.filter("at_least", lambda p: p >= 0.5)
    return found.select(F.col("id").alias("doc_id"), severity(F.col("at_least")).alias("severity"), F.size(passed).cast("long").alias("grade"), (F.size(passed) > 0).alias("toxic"))
