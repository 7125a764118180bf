"""Which arriving keys may be stored already: Bloom filters that are tables.

A stored batch has one filter per kind of key. It is split into blocks of
``WORDS`` words of 64 bits. A key belongs to one block and sets one bit in each
word, so a filter is a table ``(block, w0, w1, ...)`` that an aggregation with a
map-side combine builds and a join by block asks. It holds ``KEY_BITS`` bits a
key, whatever their number, and never lies on the driver.

A stored key is always found. A key that is not stored passes by chance, about
once in a thousand; whoever asks looks the passing keys up, so results do not
depend on the filters. Null keys are never found.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copytrace.session import materialize

WORDS = 8
WORD_BITS = 64
KEY_BITS = 16
NAMES = [f"w{i}" for i in range(WORDS)]


def blocks_for(keys: int) -> int:
    return max(1, -(-keys * KEY_BITS // (WORDS * WORD_BITS)))


def _bits(key: Column) -> list[Column]:
    """The key's bit in each word, as a word; six bits of a second hash say which."""
    second = F.xxhash64(key, F.lit("bits"))
    places = [F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int") for i in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places]


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks)


def build_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """block, w0..: the filter of the non-null values of ``key``."""
    text = F.col(key).cast("string")
    placed = keys.filter(text.isNotNull()).select(
        _block(text, F.lit(blocks)).alias("block"), *[b.alias(n) for n, b in zip(NAMES, _bits(text))]
    )
    return placed.groupBy("block").agg(*[F.bit_or(n).alias(n) for n in NAMES])


@dataclass(frozen=True)
class StoredKeys:
    """Stored rows of one kind with their filters, both split by ``batch``."""

    stored: DataFrame
    key: str
    filters: DataFrame
    blocks: Mapping[int, int]  # of each batch

    def may_hold(self, keys: DataFrame) -> DataFrame:
        """key, batch: the values of ``keys`` that the batch may hold."""
        kind = self.stored.schema[self.key].dataType
        text = F.col(self.key).cast("string")
        batches = F.array(*[F.struct(F.lit(b).alias("batch"), F.lit(n).cast("long").alias("blocks")) for b, n in self.blocks.items()])
        asked = keys.select(F.col(self.key).cast(kind)).filter(text.isNotNull()).distinct()
        asked = asked.select(self.key, F.explode(batches).alias("_b"))
        asked = asked.select(
            self.key,
            F.col("_b.batch").alias("batch"),
            _block(text, F.col("_b.blocks")).alias("block"),
            *[b.alias(f"_{n}") for n, b in zip(NAMES, _bits(text))],
        )
        every = F.lit(True)
        for n in NAMES:
            every = every & (F.col(n).bitwiseAND(F.col(f"_{n}")) == F.col(f"_{n}"))
        return asked.join(self.filters, ["batch", "block"]).filter(every).select(self.key, "batch")

    def known(self, keys: DataFrame) -> DataFrame | None:
        """Stored rows whose key is among ``keys`` or passes for one; None, without a look at them, when there is none.

        Only the batches with a passing key are read.
        """
        passing = materialize(self.may_hold(keys), "passing")
        batches = [r["batch"] for r in passing.select("batch").distinct().collect()]  # at most one row a batch
        if not batches:
            return None
        rows = self.stored.filter(F.col("batch").isin(batches)).drop("batch")
        return rows.join(passing.select(self.key).distinct(), self.key, "left_semi")
