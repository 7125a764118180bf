"""Nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

The tree is fitted on at most ``SAMPLE`` vectors (the first by a hash of the
id), a documented bound; every vector is indexed: it descends to the nearest
child until it reaches a leaf. A query walks the tree with a priority queue
that opens the nearest node next, which yields leaves from near to far; the
first ``visits`` of them are searched.

``visits`` is calibrated: for up to ``PROBES`` stored vectors the exact
neighbours come from one pass over all vectors; the visits are widened until
``RECALL`` of them lie in the visited leaves.

Equal vectors are one row of the index with its k + 1 smallest ids, all that a
list of k neighbours can show. Queries of equal vectors are answered once. A
leaf's vectors and its queries are dealt into tiles of about ``CHUNK`` of
either, one per pair of chunks; each tile hands on its best k + 1.

Scores are dot / (norm x norm) in double precision on the original vectors,
added up in one fixed order, so equal vectors tie exactly. Ties go to the
smaller id.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite
component and rows without an id take no part; vectors shorter than the
longest one count as padded with zeros; rows sharing an id are one candidate
each; fewer candidates than k give all of them; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copytrace.llm.common import embeddings
from copytrace.session import materialize

K = 5
SAMPLE = 16384
PROBES = 200
RECALL = 0.97
BRANCH = 8
LEAF = 1024  # stored vectors in a leaf, as far as the sample can tell leaves apart
LEAST_LEAF = 16  # sample vectors in a leaf
CHUNK = 4096
_SLACK = 1e-9


def usable(vector: str) -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def vectors_of(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): usable rows with the vector as array<double>, padded to the longest."""
    v = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable("v"))
    width = rows.agg(F.max(F.size("v")), F.min(F.size("v"))).first()
    if width[0] != width[1]:
        rows = rows.select("id", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width[0]) - F.size("v"))).alias("v"))
    return rows


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that tiny and huge components neither vanish nor overflow.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, each in the same order of additions."""
    return (a * b).sum(axis=-1) / (np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1)))


@dataclass
class Tree:
    """Nodes by number: centre, children (none for a leaf)."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)

    def add(self, centre: np.ndarray) -> int:
        self.centres.append(centre)
        self.children.append([])
        return len(self.centres) - 1

    def stacked(self) -> list[np.ndarray | None]:
        return [np.stack([self.centres[c] for c in kids]) if kids else None for kids in self.children]

    def leaves(self) -> int:
        return sum(not kids for kids in self.children)

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector."""
        out = np.zeros(len(vectors), np.int64)
        stack = [(0, np.arange(len(vectors)))]
        below = self.stacked()
        while stack:
            node, rows = stack.pop()
            if below[node] is None or not len(rows):
                out[rows] = node
                continue
            centres = below[node]
            near = ((centres * centres).sum(axis=1) - 2 * vectors[rows] @ centres.T).argmin(axis=1)
            stack.extend((kid, rows[near == i]) for i, kid in enumerate(self.children[node]))
        return out

    def walk(self, vector: np.ndarray, below: list[np.ndarray | None]) -> Iterator[int]:
        """Leaves, nearest open node first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if below[node] is None:
                yield node
                continue
            gap = below[node] - vector
            for far, kid in zip((gap * gap).sum(axis=1).tolist(), self.children[node]):
                heapq.heappush(queue, (far, kid))


def fit_tree(sample: np.ndarray, leaf: int, seed: int = 3) -> Tree:
    """Hierarchical k-means over a bounded sample of unit vectors."""
    rng = np.random.default_rng(seed)
    tree = Tree()
    stack = [(tree.add(sample.mean(axis=0) if len(sample) else np.zeros(1)), np.arange(len(sample)))]
    while stack:
        node, rows = stack.pop()
        if len(rows) <= max(leaf, BRANCH):
            continue
        points = sample[rows]
        centres = points[rng.choice(len(points), BRANCH, replace=False)]
        for _ in range(8):
            near = ((centres * centres).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
            filled = np.unique(near)
            centres = np.stack([points[near == i].mean(axis=0) for i in filled])
        near = ((centres * centres).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
        filled = np.unique(near)
        if len(filled) < 2:
            continue
        for i in filled:
            kid = tree.add(centres[i])
            tree.children[node].append(kid)
            stack.append((kid, rows[near == i]))
    return tree


def _best(queries: np.ndarray, vectors: np.ndarray, ready: np.ndarray, keep: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the rows that can be among its ``keep`` best, with exact scores; ties stay in."""
    rough = unit(queries) @ ready.T
    out = []
    for q, row in zip(queries, rough):
        near = np.arange(len(row))
        if len(row) > keep:
            near = np.flatnonzero(row >= np.partition(row, len(row) - keep)[len(row) - keep] - _SLACK)
        out.append((near, cosine(q, vectors[near])))
    return out


def calibrate(indexed: DataFrame, tree: Tree, k: int) -> int:
    """Leaf visits that reach ``RECALL`` of the exact neighbours of a bounded number of stored vectors."""
    probes = indexed.orderBy(F.xxhash64("mark", "cid"), "cid").limit(PROBES).select("cid", "mark", "v").toPandas()
    if not len(probes):
        return 1
    own = list(zip(probes.cid, probes.mark))
    asked = unit(matrix(probes.v))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            score = asked @ unit(matrix(batch.v)).T
            known = {key: i for i, key in enumerate(zip(batch.cid, batch.mark))}
            for probe, key in enumerate(own):
                if key in known:
                    score[probe, known[key]] = -2.0  # not its own neighbour
            keep = min(k, score.shape[1])
            at = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
            yield pd.DataFrame({"probe": np.repeat(np.arange(len(own)), keep), "score": np.take_along_axis(score, at, 1).ravel(), "leaf": batch.leaf.to_numpy()[at].ravel()})

    found = indexed.select("cid", "mark", "v", "leaf").mapInPandas(nearest, "probe int, score double, leaf long")
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "leaf")
    hits = found.where("score > -2").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("probe", "leaf").toPandas()  # PROBES x k rows
    below = tree.stacked()
    ranks = []
    for probe, leaves in hits.groupby("probe").leaf:
        place = {leaf: i for i, leaf in enumerate(tree.walk(asked[probe], below))}
        ranks.extend(place[leaf] for leaf in leaves)
    if not ranks:
        return 1
    return int(np.sort(ranks)[int(np.ceil(RECALL * len(ranks))) - 1]) + 1


def search(table: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row where ``is_query`` (over ``id``)."""
    keep = k + 1
    rows = materialize(vectors_of(table, id_col, vector_col), "vectors")
    # Classes of equal vectors with their k + 1 smallest ids. One id may come with several vectors, so a class
    # is named by its smallest id and a hash of its content.
    order = Window.partitionBy("v").orderBy("id")
    first = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)
    classes = first.groupBy("v").agg(F.min("id").alias("cid"), F.array_sort(F.collect_list("id")).alias("ids"))
    classes = materialize(classes.select("cid", F.xxhash64("v").alias("mark"), "v", "ids"), "classes")
    stored = classes.count()
    sample = classes.orderBy(F.xxhash64("mark", "cid"), "cid").limit(SAMPLE).select("v").toPandas()
    tree = fit_tree(unit(matrix(sample.v)) if len(sample) else np.zeros((0, 1)), max(LEAST_LEAF, len(sample) * LEAF // max(stored, 1)))
    shared = table.sparkSession.sparkContext.broadcast(tree)  # bounded by the sample

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(leaf=shared.value.assign(unit(matrix(batch.v))))

    indexed = materialize(classes.mapInPandas(index, "cid long, mark long, v array<double>, ids array<long>, leaf long"), "leaves")
    visits = calibrate(indexed, tree, k)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        below = shared.value.stacked()
        for batch in batches:
            if len(batch):
                yield batch.assign(leaf=[list(islice(shared.value.walk(x, below), visits)) for x in unit(matrix(batch.v))])

    asked = materialize(rows.where(is_query).withColumn("mark", F.xxhash64("v")), "queries")
    distinct = asked.groupBy("v", "mark").agg(F.min("id").alias("qid"))
    visited = materialize(distinct.select("qid", "mark", "v").mapInPandas(visit, "qid long, mark long, v array<double>, leaf array<long>"), "visits")
    # A row per leaf of the bounded tree: chunks of its vectors and parts of its queries.
    chunks = indexed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("long").alias("chunks"))
    parts = visited.select(F.explode("leaf").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("long").alias("parts"))
    tiles = F.broadcast(chunks.join(parts, "leaf"))
    every = {n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)) for n in ("chunks", "parts")}
    dealt = indexed.join(tiles, "leaf").withColumn("chunk", F.pmod(F.xxhash64("cid", "mark"), "chunks"))
    dealt = dealt.withColumn("part", every["parts"]).drop("chunks", "parts")
    visited = visited.select("qid", "mark", "v", F.explode("leaf").alias("leaf")).join(tiles, "leaf")
    visited = visited.withColumn("part", F.pmod(F.xxhash64("qid", "mark"), "parts"))
    visited = visited.withColumn("chunk", every["chunks"]).drop("chunks", "parts")

    def meet(asking: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asking) and len(vectors):
            x, ids = matrix(vectors.v), vectors.ids.to_numpy()
            ready = unit(x)
            for at in range(0, len(asking), 256):
                part = asking.iloc[at : at + 256]
                for qid, mark, (near, score) in zip(part.qid, part.mark, _best(matrix(part.v), x, ready, keep)):
                    found = sorted((-s, i) for j, s in zip(near, score) for i in ids[j])[:keep]
                    out.extend((qid, mark, i, -s) for s, i in found)
        return pd.DataFrame(out, columns=["qid", "mark", "id", "score"])

    tile = ["leaf", "chunk", "part"]
    found = visited.groupBy(*tile).cogroup(dealt.groupBy(*tile)).applyInPandas(meet, "qid long, mark long, id long, score double")
    order = Window.partitionBy("qid", "mark").orderBy(F.desc("score"), "id")
    best = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)
    best = best.groupBy("qid", "mark").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "id"))).alias("near"))
    # Back to the query rows: leave out the row itself, number the rest.
    named = distinct.select("v", "qid")
    mine = asked.join(named, "v").select("id", "qid", "mark").join(best, ["qid", "mark"])
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    listed = mine.select("id", F.posexplode(others).alias("at", "hit"))
    return listed.select(F.col("id").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.far")).alias("score"))


def op3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest found of every vector whose id is divisible by 50."""
    return search(embeddings(spark, folder), F.col("id") % 50 == 0)
