"""SimHash near-duplicates by pigeonring filtering.

Fingerprint: texts are lower-cased (A-Z), cut into words, and each run of four
words, repeats included, is hashed with XXH64 (UTF-8, seed 42). A bit is 1 if
it is set in over half of the hashes. Fewer words give one shingle, no word
gives fingerprint zero. Two fingerprints are linked at ``MAX_BITS`` = 4 or
fewer differing bits.

Pigeonring: with the 64 bits on a ring of five segments, two linked
fingerprints have a segment from which on every chain of consecutive segments
keeps within its share of the budget: 0, 1, 2, 3 and 4 differing bits for 1 to
5 segments. Candidates therefore agree in the first segment and, as the next
one holds at most one difference and the next two at most two, in both halves
of the next segment or in one half of each of the next two. These five
combinations for five starts are the join keys (25 keys of about 26 bits).
Within a bucket the whole chain is checked before the full distance.

Equal fingerprints are one row from the start. A bucket of over ``CHUNK`` rows
is dealt into chunks and joined as pairs of chunks, so no task meets more than
two of them; no candidate is given up. Within a bucket only a spanning forest
of its links is emitted.

Defined cases: a null text counts as empty; rows sharing an id keep their own
fingerprints and the same smallest-id rule; null ids never become a
component's id unless all its ids are null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from copytrace.llm.common import documents, spread, text_of
from copytrace.llm.components import components
from copytrace.session import materialize

MAX_BITS = 4
SHINGLE = 4
CHUNK = 512
# (lowest bit, width) of the ring's five segments; each has a low and a high half.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
_BLOCK = 1 << 16


def fingerprint_of(text: str) -> int:
    """Fingerprint of one text as an unsigned 64-bit number."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE + 1)
    starts, ends = starts[:n], ends[-n:]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        spans = zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist())
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint_of(t) for t in texts], np.uint64).view(np.int64))


def _bits(low: int, width: int) -> Column:
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))


def _halves(segment: int) -> list[tuple[int, int]]:
    low, width = SEGMENTS[segment % 5]
    return [(low, width // 2), (low + width // 2, width - width // 2)]


def _keys() -> Column:
    keys = []
    for start in range(5):
        near, far = _halves(start + 1), _halves(start + 2)
        for i, (x, y) in enumerate([(near[0], near[1]), *((a, b) for a in near for b in far)]):
            parts = F.shiftleft(F.lit(start * 5 + i).cast("long"), 40), F.shiftleft(_bits(*SEGMENTS[start]), 20), F.shiftleft(_bits(*x), 10), _bits(*y)
            key = parts[0]
            for p in parts[1:]:
                key = key.bitwiseOR(p)
            keys.append(key)
    return F.array(*keys)


def _mask(segment: int) -> np.uint64:
    low, width = SEGMENTS[segment % 5]
    return np.uint64(((1 << width) - 1) << low)


def _linked(x: np.ndarray, start: int) -> np.ndarray:
    """Which differences ``x`` keep every chain from ``start`` within budget, and so the whole distance too."""
    keep = np.arange(len(x))
    seen = np.uint64(0)
    for step in range(5):
        seen |= _mask(start + step)
        keep = keep[np.bitwise_count(x[keep] & seen) <= MAX_BITS * (step + 1) // 5]
    return keep


def _forest(fps: np.ndarray, start: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of the links that the chain from ``start`` finds in one bucket."""
    edges, rest = [], np.arange(len(fps))
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            node = front.pop()
            hit = _linked(fps[rest] ^ fps[node], start)
            if len(hit):
                found = rest[hit]
                edges.append((np.full(len(found), fps[node]), fps[found]))
                front.extend(found)
                rest = np.delete(rest, hit)
    return edges


def _bucket_links(key: np.ndarray, tile: np.ndarray, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of rows sorted by (key, tile); all rows of the last bucket are there."""
    edges = []
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])))
    at = np.flatnonzero(new)
    sizes = np.diff(np.append(at, len(key)))
    small = np.repeat(sizes <= 16, sizes)
    run = np.cumsum(new)
    start_of = (key >> 40) // 5
    for gap in range(1, 16):
        left = np.flatnonzero((run[gap:] == run[:-gap]) & small[gap:])
        if not len(left):
            break
        x = fps[left] ^ fps[left + gap]
        for start in range(5):
            own = np.flatnonzero(start_of[left] == start)
            hit = own[_linked(x[own], start)]
            edges.append((fps[left[hit]], fps[left[hit] + gap]))
    for a, n in zip(at[sizes > 16], sizes[sizes > 16]):
        edges.extend(_forest(fps[a : a + n], int(start_of[a])))
    return edges


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reads rows sorted by bucket; the bucket at a batch's end waits for the next batch."""
    held = None

    def out(rows: pd.DataFrame) -> pd.DataFrame:
        found = _bucket_links(rows.key.to_numpy(), rows.tile.to_numpy(), rows.fp.to_numpy().view(np.uint64))
        a, b = (np.concatenate([e[i] for e in found]) if found else np.zeros(0, np.uint64) for i in (0, 1))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}).drop_duplicates()

    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        last = (rows.key == rows.key.iloc[-1]) & (rows.tile == rows.tile.iloc[-1]) if len(rows) else None
        if last is None:
            continue
        held = rows[last]
        if not last.all():
            yield out(rows[~last])
    if held is not None and len(held):
        yield out(held)


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fps(fp)`` that connect all their components."""
    buckets = fps.select("fp", F.explode(_keys()).alias("key"))
    hot = materialize(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * CHUNK), "hot-buckets")
    if hot.isEmpty():
        tiled = buckets.withColumn("tile", F.lit(0))
    else:
        chunks = F.ceil(F.col("n") / CHUNK).cast("int")
        own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
        other = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.least(own, j) * chunks + F.greatest(own, j))
        tiles = F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(other)
        tiled = buckets.join(hot, "key", "left").select("fp", "key", F.explode(tiles).alias("tile"))
    dealt = tiled.repartition("key", "tile").sortWithinPartitions("key", "tile")
    return dealt.mapInPandas(_links, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): one row per input row; ``component`` is the smallest id reachable by links."""
    own = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col)), "id")
    own = materialize(own.select("id", fingerprint(text_of(text_col)).alias("fp")), "fingerprints")
    classes = materialize(own.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    found = materialize(components(fingerprint_links(classes.select("fp"))), "components")
    joined = classes.join(found, classes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = joined.groupBy("root").agg(F.min("least").alias("component"))
    labels = joined.join(named, "root").select("fp", "component")
    return own.join(labels, "fp").select("id", "fp", "component")


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    found = simhash_components(documents(spark, folder))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
