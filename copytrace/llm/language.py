"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier over hashed character
n-grams predicts each bit. Decoding weighs every bit by its logistic loss: the
nearest codeword is the one with the least total loss, and a softmax over the
negative losses gives the score. A text whose two nearest codewords come close
is flagged as ambiguous.

Up to seven languages get the exhaustive code (2^(k-1) - 1 bits, every split
of the languages once), more get rows of a seeded random code of 8 log2 k + 16 bits.

Features: lower-cased text, anything but letters counts as one break, hashed
1- to 3-grams, square roots of their counts, unit length. Whole texts are read.

The classifiers are fitted on at most ``PER_LANGUAGE`` texts of each language
(the first by a hash of the id), a bounded and documented sample; everything
else covers all rows. The driver sees that sample's sparse features only.

Defined cases: a null text or one without letters is ``und`` with score 0; with
no labelled text to learn from every text is ``und``; with one language every
text with letters is that language with score 1; rows without an id or without
a label are never learned from; equal rows get equal answers; an empty table
gives an empty result; other columns are carried along as a struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copytrace.llm.common import documents, spread, text_of
from copytrace.session import fits_broadcast, materialize

PER_LANGUAGE = 500
SLOTS = 1 << 13
STEPS = 150
MARGIN = 0.1
UNKNOWN = "und"
# Odd multipliers of the n-gram hash.
_MIX = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def counts_of(text: str) -> np.ndarray | None:
    """Unit feature vector of a text, None if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    codes = np.where(_letters()[codes], codes, np.uint32(0))
    if not codes.any():
        return None
    codes = np.concatenate((np.zeros(1, "<u4"), codes, np.zeros(1, "<u4")))
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]  # one break for a run of others
    bits = SLOTS.bit_length() - 1
    a, b, c = (codes * m for m in _MIX)
    found = np.zeros(SLOTS, np.int64)
    for mixed in (a[1:-1], a[:-1] ^ (b[1:] + np.uint32(0x27D4EB2F)), a[:-2] ^ (b[1:-1] << np.uint32(7)) ^ (c[2:] >> np.uint32(3))):
        found += np.bincount((mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits), minlength=SLOTS)
    vector = np.sqrt(found).astype(np.float32)
    return vector / np.float32(np.sqrt(float(found.sum())))


def codewords(languages: int) -> np.ndarray:
    """One row of -1 / +1 per language, no two rows alike."""
    if languages <= 7:
        bits = max(1, 2 ** (languages - 1) - 1)
        columns = [[1, *(1 if b >> i & 1 else -1 for i in range(languages - 1))] for b in range(bits)]
        return np.array(columns, np.float32).T
    bits = 8 * int(np.ceil(np.log2(languages))) + 16
    rng = np.random.default_rng(7)
    while True:
        code = rng.choice(np.array([-1, 1], np.float32), (languages, bits))
        split = np.abs(code.sum(axis=0)) < languages  # a bit that is the same for all tells nothing
        if split.all() and len(np.unique(code, axis=0)) == languages:
            return code


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # slots x bits
    bias: np.ndarray

    def decode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its score and whether it is ambiguous."""
        if len(self.languages) == 1:
            n = len(vectors)
            return np.zeros(n, int), np.ones(n), np.zeros(n, bool)
        margins = (vectors @ self.weights + self.bias).astype(np.float64)
        loss = np.stack([np.logaddexp(0.0, -margins * word).sum(axis=1) for word in self.code], axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        top = np.sort(share, axis=1)
        return best, top[:, -1], top[:, -1] - top[:, -2] < MARGIN


def fit_codes(languages: list[str], vectors: np.ndarray, truth: np.ndarray) -> Model:
    """Logistic regression of every code bit, all at once, by accelerated gradient steps."""
    code = codewords(len(languages))
    signs = code[truth]
    share = 1.0 / np.bincount(truth, minlength=len(languages))[truth]  # languages count alike
    share = (share / share.sum()).astype(np.float32)[:, None]
    weights = np.zeros((vectors.shape[1], code.shape[1]), np.float32)
    bias = np.zeros(code.shape[1], np.float32)
    ahead, ahead_bias = weights, bias
    step, decay = np.float32(4.0), np.float32(1e-5)
    for k in range(STEPS):
        slope = -signs * share / (1.0 + np.exp(np.clip(signs * (vectors @ ahead + ahead_bias), -30, 30)))
        new, new_bias = ahead - step * (vectors.T @ slope + decay * ahead), ahead_bias - step * slope.sum(axis=0)
        momentum = np.float32(k / (k + 3))
        ahead, ahead_bias = new + momentum * (new - weights), new_bias + momentum * (new_bias - bias)
        weights, bias = new, new_bias
    return Model(languages, code, weights, bias)


def _sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for lang, text in zip(batch.lang, batch.text):
            vector = counts_of(text)
            if vector is not None:
                at = np.flatnonzero(vector)
                rows.append((lang, at.astype("<u2").tobytes(), vector[at].tobytes()))
        yield pd.DataFrame(rows, columns=["lang", "slots", "amounts"])


def learn(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on a bounded sample of the rows where ``learnable``; None without any."""
    ids = docs.where(learnable & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"))
    # A language's rows below a hash limit that leaves some twice the number wanted; then the first of them.
    share = ids.groupBy("lang").agg((F.lit(2.0 * PER_LANGUAGE + 100) / F.count(F.lit(1))).alias("share"))
    share = materialize(share, "languages")
    share = F.broadcast(share) if fits_broadcast(share, 128, 8 << 20) else share
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    few = ids.join(share, "lang").where(place <= F.col("share") * (1 << 40)).select("id", "lang", place.alias("place"))
    order = Window.partitionBy("lang").orderBy("place", "id")
    chosen = few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= PER_LANGUAGE).select("id").distinct()
    # At most PER_LANGUAGE ids of a language.
    rows = docs.where(learnable & F.col(lang_col).isNotNull()).join(F.broadcast(chosen), F.col(id_col) == chosen.id, "left_semi")
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"))
    found = rows.mapInPandas(_sparse, "lang string, slots binary, amounts binary").toPandas()
    if not len(found):
        return None
    found = found.sort_values(["lang", "slots", "amounts"], ignore_index=True).groupby("lang").head(PER_LANGUAGE)
    languages = sorted(found.lang.unique())
    vectors = np.zeros((len(found), SLOTS), np.float32)
    for row, slots, amounts in zip(vectors, found.slots, found.amounts):
        row[np.frombuffer(slots, "<u2")] = np.frombuffer(amounts, np.float32)
    return fit_codes(languages, vectors, np.searchsorted(languages, found.lang.to_numpy(dtype=str)))


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score, ambiguous) of every input row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # slots x bits, however many rows

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def decide(texts: pd.Series) -> pd.DataFrame:
        known = shared.value
        out = pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": 0.0, "ambiguous": False})
        if known is None:
            return out
        for at in range(0, len(texts), 256):
            vectors = [(i, v) for i, t in enumerate(texts[at : at + 256], at) if (v := counts_of(t)) is not None]
            if vectors:
                rows = [i for i, _ in vectors]
                best, score, near = known.decode(np.stack([v for _, v in vectors]))
                out.loc[rows, "lang"] = np.array(known.languages, object)[best]
                out.loc[rows, "score"] = score
                out.loc[rows, "ambiguous"] = near
        return out

    return docs.select(F.struct("*").alias("row"), decide(text_of(text_col)).alias("p")).select(
        "row", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.ambiguous").alias("ambiguous")
    )


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every document."""
    docs = documents(spark, folder)
    model = learn(docs, ~held_out())
    found = predict(spread(docs.select("doc_id", "text"), "doc_id"), model)
    return found.select("row.doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
