"""Token counts of whole texts.

Counting runs in Arrow-batched functions that return lengths only. Texts are
split at safe boundaries: before a space that has a character other than white
space on at least one side. Byte-level BPE attaches such a space to what
follows it, and no token and no special string reaches across it, so the
pieces' counts add up to the text's. Arrow numbers the distinct pieces of a
batch; those seen before come from a bounded cache, the others are encoded in
batches balanced by bytes.

Defined cases: a null or empty text has 0 bytes and 0 tokens; special strings
inside a text count as the library's default counts them; equal rows each get
their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from copytrace.llm.common import documents, spread, text_of
from copytrace.llm.pieces import PieceCache, cut_safely

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512

SPECIAL = "<|"  # next to a special string white space is grouped otherwise, so a text that may hold one stays whole


class PieceLengths(PieceCache):
    """Token counts; a piece is known by its text with the leading space."""

    def value(self, ids: list[int]) -> int:
        return len(ids)

    def values(self, ids: np.ndarray, bounds: np.ndarray) -> list[int]:
        return np.diff(bounds).tolist()

    def is_word(self, piece: str) -> bool:
        return piece[:1] == " " and piece[1:].isalpha()

    def is_mark(self, token: str) -> bool:
        return token.startswith("\u0120")  # stands for a space

    def split(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate((np.flatnonzero(self.marked[ids]), [len(ids)]))

    def counts(self, texts: pa.Array | list[str]) -> np.ndarray:
        pieces = cut_safely(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), SPECIAL)
        return pieces.totals(self.find(pieces.entries))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row. ``path``: vocabulary file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = PieceLengths.shared(path).counts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(counts)], ["id", "n_bytes", "n_tokens"])

    source = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    text = text_of("text")
    source = source.select("id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    schema = StructType([*source.schema.fields[:2], StructField("n_tokens", LongType())])
    return source.mapInArrow(run, schema)


def op6_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    found = count_tokens(documents(spark, folder))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
