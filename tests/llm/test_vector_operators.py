import numpy as np
import pytest
from helpers import folder

from copytrace.llm import ann, vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, dims, seed, near=0.3):
    rng = np.random.default_rng(seed)
    out = rng.normal(size=(n, dims)).astype(np.float32)
    for i in range(1, n):
        if rng.random() < near:
            out[i] = out[rng.integers(0, i)] * np.float32(rng.uniform(0.5, 2)) + rng.normal(size=dims).astype(np.float32) * np.float32(rng.choice([0, 0.05, 0.3, 0.5]))
    return [(i, v.tolist(), 0) for i, v in enumerate(out)]


ODD = [
    (1001, None, 1),
    (1002, [], 1),
    (1003, [0.0] * 8, 1),
    (1004, [float("nan")] + [1.0] * 7, 1),
    (1005, [float("inf")] + [1.0] * 7, 1),
    (1006, [None] + [1.0] * 7, 1),
    (1007, [1e-30] + [0.0] * 7, 1),
    (1008, [1.0], 1),
    (1050, None, 1),
    (None, [2.0] + [0.0] * 7, 1),
]


def usable(rows, dims):
    out = []
    for i, v, _ in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            out.append((i, np.pad(np.array(v, np.float32).astype(float), (0, dims - len(v)))))
    return out


def brute_links(rows, dims, t=0.9):
    used = usable(rows, dims)
    x = np.stack([v for _, v in used]) if used else np.zeros((0, dims))
    u = x / np.abs(x).max(axis=1, keepdims=True)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= t
    np.fill_diagonal(link, False)
    ids = [i for i, _ in used]
    group = np.array(ids)
    while True:
        new = np.where(link, group[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        new = np.minimum(new, group)
        if (new == group).all():
            break
        group = new
    out = [(i, int(n), int(g), i == g) for i, n, g in zip(ids, link.sum(axis=1), group)]
    out += [(i, 0, i, True) for i, *_ in rows if i not in set(ids)]
    return sorted(out, key=repr)


def dedup(spark, tmp_path, rows):
    found = vector_dedup.op2_vector_dedup(spark, folder(tmp_path, spark, embeddings=spark.createDataFrame(rows, SCHEMA)))
    return sorted(map(tuple, found.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


@pytest.mark.parametrize("dims, n", [(8, 150), (64, 250), (3, 60), (1, 10)])
def test_links(spark, tmp_path, dims, n):
    rows = vectors(n, dims, dims)
    assert dedup(spark, tmp_path, rows) == brute_links(rows, dims)


def test_odd_vectors_and_copies(spark, tmp_path):
    rows = vectors(40, 8, 3) + ODD + [(2000 + i, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 0.0, 1.0], 0) for i in range(30)]
    assert dedup(spark, tmp_path, rows) == brute_links(rows, 8)


def test_many_cells_and_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_dedup, "CELL", 20)
    monkeypatch.setattr(vector_dedup, "CHUNK", 7)
    rows = vectors(220, 32, 9, near=0.6)
    assert dedup(spark, tmp_path, rows) == brute_links(rows, 32)


@pytest.mark.parametrize("rows", [[], [(1, None, 0)]])
def test_nothing_to_link(spark, tmp_path, rows):
    assert dedup(spark, tmp_path, rows) == [(i, 0, i, True) for i, *_ in rows]


def test_cells_hold_every_pair_in_range():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(200, 4)) * 0.2
    pivots = points[:9]
    own, visit = vector_dedup.cells(points, pivots, 0.15)
    far = np.linalg.norm(points[:, None] - points[None], axis=2)
    for i, j in zip(*np.nonzero(far <= 0.15)):
        low = min(own[i], own[j])
        assert (own[i] == low or visit[i, low]) and (own[j] == low or visit[j, low])


def brute_nearest(rows, dims, k=5):
    used = usable(rows, dims)
    out = {}
    for i, v in used:
        if i % 50 == 0:
            scores = sorted((-(v @ w) / (np.linalg.norm(v) * np.linalg.norm(w)), j) for j, w in used if j != i)
            out[i] = [(j, -s) for s, j in scores[:k]]
    return out


def search(spark, tmp_path, rows):
    found = ann.op3_neighbours(spark, folder(tmp_path, spark, embeddings=spark.createDataFrame(rows, SCHEMA))).collect()
    lists = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        lists.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(lists[r.query_id])
    return lists


@pytest.mark.parametrize("chunk", [7, 4096])
def test_recall(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(ann, "LEAF", 64)
    monkeypatch.setattr(ann, "CHUNK", chunk)
    rows = vectors(1500, 16, 4)
    found, want = search(spark, tmp_path, rows), brute_nearest(rows, 16)
    assert found.keys() == want.keys()
    hits = sum(len({j for j, _ in found[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    for q, near in found.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0])) and q not in [j for j, _ in near]


def test_copies_odd_vectors_and_few_candidates(spark, tmp_path):
    copies = [(i, [1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0], 0) for i in (50, 7, 3, 9, 11, 100, 2, 150)]
    rows = copies + ODD + [(0, [1.0, 0.1] + [0.0] * 6, 0)]
    found, want = search(spark, tmp_path, rows), brute_nearest(rows, 8)
    assert {q: [j for j, _ in x] for q, x in found.items()} == {q: [j for j, _ in x] for q, x in want.items()}
    few = [(0, [1.0, 2.0], 0), (1, [2.0, 1.0], 0), (50, [0.0, 1.0], 0)]
    assert {q: len(x) for q, x in search(spark, tmp_path / "few", few).items()} == {0: 2, 50: 2}


@pytest.mark.parametrize("rows", [[], [(50, None, 0)], [(50, [1.0], 0)]])
def test_nothing_to_find(spark, tmp_path, rows):
    assert search(spark, tmp_path, rows) == {}


def test_best_bin_first_visits_every_leaf_once():
    sample = ann.unit(np.random.default_rng(2).normal(size=(400, 6)))
    tree = ann.fit_tree(sample, 16)
    walked = list(tree.walk(sample[0], tree.stacked()))
    assert len(walked) == len(set(walked)) == tree.leaves() and set(tree.assign(sample)) <= set(walked)


def test_vectors_travel_in_the_type_they_were_given(spark, monkeypatch):
    written, write = {}, vector_dedup.materialize
    monkeypatch.setattr(vector_dedup, "materialize", lambda df, name: written.setdefault(name, df) and write(df, name))
    vector_dedup.near_duplicates(spark.createDataFrame(vectors(30, 8, 4), SCHEMA)).collect()
    assert written["classes"].schema["v"].dataType.simpleString() == "array<float>"
