"""Balanced L2 logistic regression over all terms, with its parameters in a table.

The terms of a text corpus have no bound. The penalised optimum is a combination
of the rows (w = X'a), and so is every iterate of L-BFGS that starts at zero:
gradients, steps and their inner products can be kept as one number a row, and
only X X'v has to be worked out for a new vector v of that kind. That is one pass
over the postings, which lie by term: each term's sum over its rows, and back to
the rows. Terms of one row only add to the diagonal and are summed once. Nothing
of vocabulary length is ever on the driver; the weights come out as a table
(term, df, idf, weight).

All labelled rows are read. Vectors of one number a row lie on the driver (8 MB
a vector at a million rows, ``MEMORY`` pairs of steps and gradients).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copytrace.functions.numeric import sigmoid
from copytrace.functions.ranking import numbered
from copytrace.operators.vectorize import attach_by_part, counts_by_part, part_of, parts_for, postings, smoothed_idf
from copytrace.session import discard, materialize

MEMORY = 10
# Numbers of a vector that lie on one row of a table.
BLOCK = 1 << 14
# Postings of a part of the matrix, about; a term is never cut.
PART_POSTINGS = 1 << 20
MATRIX = "terms array<string>, idfs binary, lengths binary, rows binary, xs binary"


@dataclass
class TermModel:
    """Weights of terms as a table (term, df, idf, weight), the intercept, and the norm of the gradient they were left at."""

    terms: DataFrame
    intercept: float
    gradient_norm: float = math.nan

    def transform(self, df: DataFrame, text: str = "text", out: str = "ai_probability") -> DataFrame:
        """``df`` and the probability of class 1; a text without a known term has that of the intercept."""
        numbers = numbered(df.select(F.struct("*").alias("_row"), F.col(text).alias("_text")), "_id", "to-score")
        margin = margins(numbers.select("_id", F.col("_text").alias("text")), self.terms, "_id")
        joined = numbers.join(margin, "_id", "left")
        p = sigmoid(F.coalesce("margin", F.lit(0.0)) + F.lit(self.intercept))
        return joined.select("_row.*", p.alias(out))

    def save(self, path: str) -> None:
        """The term table, and one row with the rest, written last: a folder without it is no model."""
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        rest = [(float(self.intercept), float(self.gradient_norm))]
        self.terms.sparkSession.createDataFrame(rest, "intercept double, gradient_norm double").coalesce(1).write.mode("overwrite").parquet(f"{path}/rest")


def load_terms(spark: SparkSession, path: str) -> TermModel | None:
    """Saved model, or None when there is none."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rest/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return None
    rest = spark.read.parquet(f"{path}/rest").first()
    return TermModel(spark.read.parquet(f"{path}/terms"), rest["intercept"], rest["gradient_norm"])


def known_postings(rows: DataFrame, terms: DataFrame, key: str, cols: list[str]) -> tuple[DataFrame, int]:
    """part, key, term, tf and ``cols`` of the terms in the table, for ``rows(key, text)``; and the number of parts they lie by.

    Only the distinct terms of a part are moved.
    """
    parts, long = parts_for(rows)
    dealt = rows.select(part_of(parts, key).alias("part"), key, "text").repartitionById(parts, F.col("part"))
    post = postings(dealt, ["part", key], n=2)
    asked = post.select("part", "term").distinct().join(terms.select("term", *cols), "term")
    return attach_by_part(post, materialize(asked, "asked"), parts, long), parts


def margins(rows: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """(key, margin): the weights' product with the unit TF-IDF row of ``rows(key, text)``."""
    found, _ = known_postings(rows, terms, key, ["idf", "weight"])
    x = F.col("tf") * F.col("idf")
    return found.groupBy("part", key).agg((F.sum(x * F.col("weight")) / F.sqrt(F.sum(x * x))).alias("margin")).drop("part")


def term_features(rows: DataFrame, n: int, max_df: float) -> tuple[DataFrame, DataFrame]:
    """(term, df, idf) of all terms in at most ``max_df`` of the ``n`` rows, and the unit rows (id, term, df, idf, w, hot_norm).

    ``hot_norm`` is the length of a row's part in terms of one row only.
    """
    parts, long = parts_for(rows)
    dealt = rows.select(part_of(parts, "id").alias("part"), "id", "text").repartitionById(parts, F.col("part"))
    post = postings(dealt, ["part", "id"], n=2)
    terms = counts_by_part(post, {"df": F.lit(1)}).where(F.col("df") <= F.lit(max(1.0, max_df * n)))
    terms = materialize(terms.select("part", "term", F.col("df").cast("long").alias("df"), "first"), "fit-terms")
    known = attach_by_part(post, terms.drop("first"), parts, long).withColumn("idf", smoothed_idf(n))
    row, raw = Window.partitionBy("id", "part"), F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(raw * raw).over(row))
    hot = F.sqrt(F.sum(F.when(F.col("df") == 1, raw * raw).otherwise(0.0)).over(row))
    found = materialize(known.select("id", "term", "df", "idf", (raw / norm).alias("w"), (hot / norm).alias("hot_norm")), "fit-rows")
    return terms.where("first").select("term", "df", smoothed_idf(n).alias("idf")), found


class Kernel:
    """X X'v for vectors v of one number a row, and X'v by term."""

    def __init__(self, weights: DataFrame, n: int):
        self.spark, self.n = weights.sparkSession, n
        squares = weights.groupBy(F.col("id").alias("row")).agg(F.max(F.col("hot_norm") * F.col("hot_norm")).alias("v")).toArrow()
        self.diagonal = np.zeros(n)
        self.diagonal[squares["row"].to_numpy()] = squares["v"].to_numpy()
        shared = weights.where("df > 1")
        cores = self.spark.sparkContext.defaultParallelism
        parts = max(cores, -(-shared.count() // PART_POSTINGS))
        lying = shared.select("term", "idf", F.col("id").cast("int").alias("row"), "w", part_of(parts, "term").alias("part"))
        lying = lying.repartitionById(parts, F.col("part")).drop("part")
        # Every product reads all of it, so executors keep it; what one of them loses is read from the files again.
        self.matrix = materialize(lying.mapInArrow(_packed, MATRIX), "fit-matrix").persist()

    def sums(self, shipped: Broadcast[np.ndarray]) -> DataFrame:
        """(block, v): the product without the diagonal, ``BLOCK`` numbers of 8 bytes a row."""
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, out = shipped.value, np.zeros(n)
            for batch in batches:
                for lengths, rows, xs in zip(*(batch.column(c) for c in ("lengths", "rows", "xs"))):
                    length, at, x = np.frombuffer(lengths.as_buffer(), np.int32), np.frombuffer(rows.as_buffer(), np.int32), np.frombuffer(xs.as_buffer())
                    of_term = np.add.reduceat(x * v[at], np.cumsum(length) - length)
                    out += np.bincount(at, x * np.repeat(of_term, length), n)
            yield from _blocks((b, out[b * BLOCK : (b + 1) * BLOCK]) for b in range(-(-n // BLOCK)))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, v in zip(batch.column("block").to_pylist(), batch.column("v")):
                    part = np.frombuffer(v.as_buffer())
                    found[block] = found[block] + part if block in found else part
            yield from _blocks(found.items())

        # At most as many numbers as there are rows from each task.
        parts = self.matrix.mapInArrow(run, "block int, v binary").repartition(F.col("block"))
        return parts.mapInArrow(add, "block int, v binary")

    def __call__(self, vector: np.ndarray) -> np.ndarray:
        shipped, out = self.spark.sparkContext.broadcast(vector), np.zeros(self.n)
        found = self.sums(shipped).toArrow()
        shipped.destroy()
        for block, v in zip(found["block"].to_pylist(), found["v"]):
            out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(v.as_buffer())
        return out + self.diagonal * vector

    def weights(self, point: np.ndarray) -> DataFrame:
        """term, df, idf, weight of the terms of several rows, from the rows' numbers."""
        shipped = self.spark.sparkContext.broadcast(point)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for terms, idfs, lengths, rows, xs in zip(*batch.columns):
                    length, at = (np.frombuffer(c.as_buffer(), np.int32) for c in (lengths, rows))
                    weight = np.add.reduceat(np.frombuffer(xs.as_buffer()) * shipped.value[at], np.cumsum(length) - length)
                    columns = [terms.values, pa.array(length.astype(np.int64)), pa.array(np.frombuffer(idfs.as_buffer())), pa.array(weight)]
                    yield pa.RecordBatch.from_arrays(columns, ["term", "df", "idf", "weight"])

        return self.matrix.mapInArrow(run, "term string, df long, idf double, weight double")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition (term, idf, row, w), which holds terms whole, on one row, numbers as bytes."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    coded = table["term"].cast(pa.large_string()).combine_chunks().dictionary_encode()
    code, row = coded.indices.to_numpy(zero_copy_only=False), table["row"].to_numpy()
    order = np.lexsort((row, code))
    length = np.bincount(code, minlength=len(coded.dictionary)).astype(np.int32)
    idf = table["idf"].to_numpy()[order][np.cumsum(length) - length]
    numbers = [idf, length, row[order], table["w"].to_numpy()[order]]
    terms = pa.ListArray.from_arrays(pa.array([0, len(length)], pa.int32()), coded.dictionary.cast(pa.string()))
    yield pa.RecordBatch.from_arrays([terms, *[pa.array([x.tobytes()], pa.binary()) for x in numbers]], [c.split()[0] for c in MATRIX.split(", ")])


def _blocks(found: Iterable[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for block, v in found:
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["block", "v"])


def minimise(kernel: Callable, y: np.ndarray, weight: np.ndarray, penalty: float, tol: float, max_iter: int) -> tuple[np.ndarray, float, float]:
    """Row coefficients a, intercept b and gradient norm of the least weighted log loss plus penalty / 2 |X'a|^2.

    A vector is (a, b): its last place is the intercept. ``image`` holds
    (X X'a, b), so the inner product of two vectors is one's values times the
    other's image.
    """
    point, image = np.zeros(len(y) + 1), np.zeros(len(y) + 1)
    pairs: list[tuple] = []  # steps and gradient changes, with images and 1 / their product
    last, norm = None, math.inf
    for _ in range(max_iter + 1):
        residual = weight * (_logistic(image[:-1] + image[-1]) - y)
        gradient = np.append(residual + penalty * point[:-1], residual.sum())
        seen = np.append(kernel(residual) + penalty * image[:-1], residual.sum())
        norm = math.sqrt(max(0.0, float(gradient @ seen)))
        if last is not None:
            step, step_image, old, old_image = last
            change, change_image = gradient - old, seen - old_image
            curve = float(step @ change_image)
            if curve > 0:
                pairs = [*pairs[1 - MEMORY :], (step, step_image, change, change_image, 1.0 / curve)]
        if norm <= tol:
            break
        way, way_image = _direction(gradient, seen, pairs)
        size = _line(way, way_image, point, image, y, weight, penalty)
        last = (size * way, size * way_image, gradient, seen)
        point, image = point + last[0], image + last[1]
    return point[:-1], float(point[-1]), norm


def _logistic(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))


def _direction(gradient: np.ndarray, image: np.ndarray, pairs: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The two-loop recursion, on values and images alike."""
    q, q_image, shares = gradient.copy(), image.copy(), []
    for step, _, change, change_image, inverse in reversed(pairs):
        share = inverse * float(step @ q_image)
        q, q_image = q - share * change, q_image - share * change_image
        shares.append(share)
    if pairs:
        _, _, change, change_image, inverse = pairs[-1]
        scale = 1.0 / (inverse * float(change @ change_image))
        q, q_image = scale * q, scale * q_image
    for (step, step_image, _, change_image, inverse), share in zip(pairs, reversed(shares)):
        more = share - inverse * float(q @ change_image)
        q, q_image = q + more * step, q_image + more * step_image
    return -q, -q_image


def _line(way, way_image, point, image, y, weight, penalty) -> float:
    """The step length at which the convex loss along ``way`` has slope zero: Newton inside a bracket."""
    margin, move = image[:-1] + image[-1], way_image[:-1] + way_image[-1]
    linear, square = penalty * float(point[:-1] @ way_image[:-1]), penalty * float(way[:-1] @ way_image[:-1])

    def slope(t: float) -> tuple[float, float]:
        p = _logistic(margin + t * move)
        return float((weight * (p - y)) @ move) + linear + t * square, float((weight * p * (1 - p)) @ (move * move)) + square

    low, high = 0.0, 1.0
    while slope(high)[0] < 0 and high < 1e10:
        low, high = high, 2 * high
    t = high if high > 1 else 1.0
    for _ in range(100):
        value, curve = slope(t)
        low, high = (t, high) if value < 0 else (low, t)
        new = t - value / curve if curve > 0 else (low + high) / 2
        if not low <= new <= high:
            new = (low + high) / 2
        if abs(new - t) <= 1e-12 * max(1.0, t):
            break
        t = new
    return t


def fit_terms(rows: DataFrame, max_df: float = 0.95, c: float = 1.0, max_iter: int = 1000, tol: float = 5e-7) -> TermModel:
    """The model of ``rows(text, target, weight)`` with target 0 or 1; without rows it has no terms and no preference.

    The penalty 1/(2 c) |w|^2 bounds the distance of the weights from the optimum by c times the gradient's norm.
    """
    rows = numbered(rows.select("text", F.col("target").cast("double").alias("target"), F.col("weight").cast("double").alias("weight")), "id", "fit-input")
    known = rows.select("id", "target", "weight").toArrow()
    n = known.num_rows
    order = np.argsort(known["id"].to_numpy())
    y, weight = (known[k].to_numpy()[order] for k in ("target", "weight"))
    vocab, weights = term_features(rows, n, max_df)
    if not n:
        return TermModel(materialize(vocab.withColumn("weight", F.lit(0.0)), "fit-weights"), 0.0, 0.0)
    discard(vocab)
    kernel = Kernel(weights, n)
    point, intercept, norm = minimise(kernel, y, weight, 1.0 / c, tol, max_iter)
    shipped = rows.sparkSession.sparkContext.broadcast(point)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = batch.column("w").to_numpy() * shipped.value[batch.column("id").to_numpy()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("term", "df", "idf")), pa.array(w)], ["term", "df", "idf", "weight"])

    single = weights.where("df = 1").select("id", "term", "df", "idf", "w").mapInArrow(alone, "term string, df long, idf double, weight double")
    terms = materialize(kernel.weights(point).unionByName(single), "fit-weights")
    kernel.matrix.unpersist()
    discard(kernel.matrix)
    discard(weights)
    return TermModel(terms, intercept, norm)
