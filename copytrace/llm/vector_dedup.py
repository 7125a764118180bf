"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= t are at most sqrt(2 - 2 t) apart. The vectors are
turned by one random rotation and split into blocks of about ``BLOCK_DIMS``
places. If a pair's squared distance is within the budget, then in at least one
block its squared distance is within the block's proportional share, so the
union of one range join per block holds every pair.

Range join of a block: every vector belongs to the cell of its nearest pivot
(pivots: a bounded sample, more of them for more vectors) and visits each
lower-numbered cell whose dividing hyperplane is within the block's radius; no
pair in range is missed, and each meets in one cell. Cells are dealt into
chunks of about ``CHUNK`` rows and joined chunk by chunk, so a crowded cell
never lands in one task.

A candidate pair is checked in double precision on the original vectors, and
counted in the first block that has it in range. Tasks emit link counts per
vector and a spanning forest of their links, never the links themselves, so
output does not grow with the square of a group.

Equal vectors are one row with a count from the start.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite
component link with nothing (0 links, a component of their own, kept); rows
without an id link with nothing and have a null component; vectors shorter than
the longest count as padded with zeros; rows that share an id are separate
vectors for the links but one id in the result: each row is returned; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copytrace.llm.ann import cosine, matrix, unit, usable, vectors_of
from copytrace.llm.common import embeddings
from copytrace.llm.components import components
from copytrace.session import materialize

THRESHOLD = 0.9
BLOCK_DIMS = 16
CELL = 32768  # vectors of a cell, as far as the pivots can tell cells apart
MOST_PIVOTS = 1024
CHUNK = 32768  # every row of a cell is sent once for each chunk that it meets
_SLACK = 1e-6
_ROUGH = 1e-4  # error of single-precision block distances at most


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same for every run."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int) -> list[slice]:
    edges = np.linspace(0, dims, max(1, round(dims / BLOCK_DIMS)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def block_distances(a: np.ndarray, b: np.ndarray, blocks: list[slice]) -> np.ndarray:
    """Squared distances row by row in each block, added up in one fixed order."""
    gap = (a - b) ** 2
    return np.stack([gap[:, s].sum(axis=1) for s in blocks], axis=1)


def cells(block: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Own cell of each row; which lower cells it also visits (rows x pivots)."""
    far = np.maximum(((block[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2), 0.0)
    own = far.argmin(axis=1)
    apart = np.sqrt(((pivots[own][:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2))
    # Distance to the plane between the own and the other pivot.
    near = far - far[np.arange(len(far)), own][:, None] <= 2 * (radius + _SLACK) * apart + _SLACK
    return own, near & (np.arange(len(pivots))[None, :] < own[:, None])


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of links that form a spanning forest of n nodes."""
    label = np.arange(n)
    used = []
    while True:
        x, y = label[a], label[b]
        open_ = np.flatnonzero(x != y)
        if not len(open_):
            return np.concatenate(used) if used else np.zeros(0, int)
        high, low = np.maximum(x[open_], y[open_]), np.minimum(x[open_], y[open_])
        _, first = np.unique(high, return_index=True)  # each label hooks on to one lower label
        used.append(open_[first])
        parent = np.arange(n)
        parent[high[first]] = low[first]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def _tile_links(left: dict, right: dict | None, block: int, blocks: list[slice], budgets: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (left, right) of the links of a tile first in range in ``block``; ``right`` None: within left."""
    other = left if right is None else right
    s = blocks[block]
    found_a, found_b = [], []
    # |p - q|^2 as one product in single precision: (-2 p, |p|^2, 1) . (q, 1, |q|^2)
    p, q = left["turned"][:, s].astype(np.float32), other["turned"][:, s].astype(np.float32)
    ones = np.ones((1, 1), np.float32)
    p = np.hstack((-2 * p, (p * p).sum(axis=1, keepdims=True), ones.repeat(len(p), 0)))
    q = np.hstack((q, ones.repeat(len(q), 0), (q * q).sum(axis=1, keepdims=True))).T
    most = np.float32(budgets[block] + _ROUGH)
    for at in range(0, len(p), 256):
        i, j = np.divmod(np.flatnonzero(p[at : at + 256] @ q <= most), q.shape[1])
        i += at
        if right is None:
            i, j = i[i < j], j[i < j]
        for cut in range(0, len(i), 1 << 16):
            x, y = i[cut : cut + (1 << 16)], j[cut : cut + (1 << 16)]
            gaps = block_distances(left["turned"][x], other["turned"][y], blocks)
            inside = gaps <= budgets + _SLACK / 2
            mine = inside[:, block] & ~inside[:, :block].any(axis=1)
            x, y = x[mine], y[mine]
            linked = cosine(left["v"][x], other["v"][y]) >= threshold
            found_a.append(x[linked])
            found_b.append(y[linked])
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.zeros(0, int), np.zeros(0, int))


def near_links(classes: DataFrame, dims: int, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, links) from ``classes(cid, n, v)``: b null: a class's links to other classes; else an edge of the forest."""
    blocks = blocks_of(dims)
    turn = rotation(dims)
    reach = 2 - 2 * threshold
    budgets = np.array([reach * (s.stop - s.start) / dims for s in blocks])
    stored = classes.count()
    pivots = min(MOST_PIVOTS, max(1, math.ceil(stored / CELL)))
    sample = classes.orderBy(F.xxhash64("cid"), "cid").limit(pivots).select("v").toPandas()
    centres = unit(matrix(sample.v)) @ turn if len(sample) else np.zeros((1, dims))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            turned = unit(matrix(batch.v)) @ turn
            for b, s in enumerate(blocks):
                own, visit = cells(turned[:, s], centres[:, s], math.sqrt(budgets[b]))
                guest, cell = np.nonzero(visit)
                rows = np.concatenate((np.arange(len(batch)), guest))
                out = batch.iloc[rows].copy()
                out["block"] = b
                out["cell"] = np.concatenate((own, cell))
                out["guest"] = np.concatenate((np.zeros(len(batch), bool), np.ones(len(guest), bool)))
                yield out

    # Vectors travel in the type they were given in: single precision is half the size and loses nothing.
    vector = classes.schema["v"].dataType.simpleString()
    fields = f"cid long, n long, v {vector}, block int, cell long, guest boolean"
    slim = materialize(classes.select("cid", F.lit(0).cast("long").alias("n"), "v").mapInPandas(_without_vectors(deal), "cid long, block int, cell long, guest boolean"), "cell-rows")
    sizes = slim.groupBy("block", "cell").agg(F.sum((~F.col("guest")).cast("long")).alias("own"), F.sum(F.col("guest").cast("long")).alias("visiting"))
    chunks = sizes.select("block", "cell", F.greatest(F.ceil(F.col("own") / CHUNK), F.lit(1)).cast("long").alias("own"), F.ceil(F.col("visiting") / CHUNK).cast("long").alias("visiting"))
    chunks = F.broadcast(chunks)  # at most blocks x MOST_PIVOTS rows
    dealt = classes.select("cid", "n", "v").mapInPandas(deal, fields).join(chunks, ["block", "cell"])
    # Tile (i, j): own chunk i with own chunk j >= i, or with visiting chunk j - own.
    mine = F.pmod(F.xxhash64("cid"), F.when(F.col("guest"), F.col("visiting")).otherwise(F.col("own")))
    with_own = F.transform(F.sequence(F.lit(0).cast("long"), F.col("own") - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
    with_guests = F.transform(F.sequence(F.lit(1).cast("long"), F.col("visiting")), lambda j: F.struct(mine.alias("i"), (F.col("own") + j - 1).alias("j")))
    none = F.filter(with_own, lambda _: F.lit(False))
    hosts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("own") - 1), lambda i: F.struct(i.alias("i"), (F.col("own") + mine).alias("j")))
    tiles = F.when(F.col("guest"), hosts).otherwise(F.concat(with_own, F.when(F.col("visiting") > 0, with_guests).otherwise(none)))
    tiled = dealt.select("cid", "n", "v", "block", "cell", "guest", mine.alias("chunk"), F.explode(tiles).alias("t"))

    def join(group: pd.DataFrame) -> pd.DataFrame:
        block, i, j = int(group.block.iloc[0]), int(group.i.iloc[0]), int(group.j.iloc[0])
        group = group.sort_values(["guest", "cid"], ignore_index=True)
        first = (~group.guest & (group.chunk == i)).to_numpy()
        v = matrix(group.v)
        all_ = {"v": v, "turned": unit(v) @ turn}
        if i == j:
            a, b = _tile_links(all_, None, block, blocks, budgets, threshold)
        else:
            left, right = np.flatnonzero(first), np.flatnonzero(~first)
            a, b = _tile_links({k: x[left] for k, x in all_.items()}, {k: x[right] for k, x in all_.items()}, block, blocks, budgets, threshold)
            a, b = left[a], right[b]
        cid, n = group.cid.to_numpy(), group.n.to_numpy()
        links = np.bincount(a, weights=n[b], minlength=len(cid)) + np.bincount(b, weights=n[a], minlength=len(cid))
        has = np.flatnonzero(links)
        tree = _forest(len(cid), a, b)
        return pd.DataFrame(
            {
                "a": np.concatenate((cid[has], cid[a[tree]])),
                "b": pd.array([*[None] * len(has), *cid[b[tree]].tolist()], "Int64"),
                "links": np.concatenate((links[has].astype(np.int64), np.zeros(len(tree), np.int64))),
            }
        )

    return tiled.select("cid", "n", "v", "block", "cell", "guest", "chunk", "t.i", "t.j").groupBy("block", "cell", "i", "j").applyInPandas(join, "a long, b long, links long")


def _without_vectors(deal):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in deal(batches):
            yield out[["cid", "block", "cell", "guest"]]

    return run


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component) of every row."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    used = vectors_of(table, id_col, vector_col)
    if table.schema[vector_col].dataType.simpleString() == "array<float>":
        used = used.select("id", F.col("v").cast("array<float>").alias("v"))
    used = materialize(used, "vectors")
    classes = used.groupBy("v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes.select("v", "least", "n", F.monotonically_increasing_id().alias("cid")), "classes")
    head = classes.select(F.size("v").alias("dims")).first()
    if head is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    found = materialize(near_links(classes, head.dims, threshold), "links")
    links = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    groups = materialize(components(found.where("b IS NOT NULL").select("a", "b")), "components")
    joined = classes.join(groups, classes.cid == groups.node, "left").select("v", "cid", "n", "least", F.coalesce("root", "cid").alias("root"))
    named = joined.groupBy("root").agg(F.min("least").alias("component"))
    labels = joined.join(named, "root").join(links, joined.cid == links.a, "left").select("v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component")
    linked = used.join(labels, "v").select("id", "n_links", "component")
    alone = rows.where(F.col("id").isNull() | ~usable("v"))
    return linked.union(alone.select("id", F.lit(0).cast("long"), F.col("id")))


def op2_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    found = near_duplicates(embeddings(spark, folder))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


SQL = """WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
c AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c.b, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""
