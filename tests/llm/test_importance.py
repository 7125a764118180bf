import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from helpers import docs, folder, got

from copytrace.llm import importance, interning

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, target, percent=5, min_words=20, buckets=importance.BUCKETS):
    """Ids with features, weight, score and rank, in plain Python."""
    s, t = [0] * buckets, [0] * buckets
    for side, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            for g in grams(text)[1]:
                side[zlib.crc32(g.encode()) % buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out, fit = [], []
    for doc, text, *_ in rows:
        n, found = grams(text)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in found)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
        if n >= min_words:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, row in enumerate(fit[: percent * len(fit) // 100], 1):
        row[4] = i
    return sorted(map(tuple, out), key=repr)


def corpus(n, seed):
    rng = random.Random(seed)
    letters = ["Alpha", "beta", "GAMMA", "été", "日本", "x1", "42", "ÀB", "the", "of"]
    return [(i, " ".join(rng.choice(letters) + rng.choice(["", "", ",", " -", "\n"]) for _ in range(rng.randint(0, 60)))) for i in range(n)]


def test_equals_brute_force(spark, tmp_path):
    rows = [*corpus(400, 13), (1000, None), (1001, ""), (1002, "w" * 300 + " " + "long " * 30), (1003, "... !!"), (None, "null id " * 15)]
    target = ["Alpha beta gamma", "the of the of", None, "日本 x1"]
    bench = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    path = folder(tmp_path, spark, documents=docs(spark, rows), benchmark=bench)
    found = importance.op13_importance(spark, path)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert got(found, *found.columns) == brute(rows, target)


def test_blocks_do_not_change_results(monkeypatch):
    texts = [t for _, t in corpus(60, 3)] + ["", "one", "z" * 700 + " " + "z" * 700 + " end"]
    monkeypatch.setattr(interning, "BLOCK", 7)
    counts = np.zeros(1000, int)
    features = np.zeros(len(texts), int)
    for table, slot, owner in interning.ngrams(interning.words(pa.array(texts)), 3, 1000):
        np.add.at(counts, table.bucket, table.count)
        features += np.bincount(owner, minlength=len(texts))
    want = np.zeros(1000, int)
    for text in texts:
        for g in grams(text)[1]:
            want[zlib.crc32(g.encode()) % 1000] += 1
    assert (counts == want).all() and features.tolist() == [len(grams(t)[1]) for t in texts]


@pytest.mark.parametrize("length", [1, 3, 4, 7, 8, 11, 31, 32, 33, 40, 63, 64, 100, 255])
def test_hashes_equal_the_libraries(length):
    data = np.random.default_rng(length).integers(0, 256, 600).astype(np.uint8)
    table = interning.Table(data, 10)
    begin = np.arange(0, 600 - length, 5)
    raw = [data[b : b + length].tobytes() for b in begin]
    assert interning.xxh64(table.lanes, begin, length).tolist() == [xxhash.xxh64_intdigest(r) for r in raw]
    assert interning.crc32(table.lanes, begin, length).tolist() == [zlib.crc32(r) for r in raw]


def test_equal_keys_of_different_slices_stay_apart(monkeypatch):
    monkeypatch.setattr(interning.Table, "_keys", lambda self, begin, length: np.zeros(len(begin), np.uint64))
    data = np.frombuffer(b"ab cd ab ef cdx" + b" " * 8, np.uint8)
    table = interning.Table(data, 5)
    two = table.intern(np.array([0, 3, 6, 9]), 2)
    three = table.intern(np.array([12]), 3)
    assert two[0] == two[2] and len({*two.tolist(), *three.tolist()}) == 4


def test_ties_repeats_and_clashing_columns(spark):
    text = "same words here " * 10
    rows = spark.createDataFrame([(7, text, 1, 2), (7, text, 3, 4), (7, text + "more", 5, 6)], "doc_id long, text string, rank int, mark int")
    found = importance.resample(rows, rows, percent=67)
    ranks = [r["rank"] for r in found.collect()]
    assert sorted(r for r in ranks if r) == [1, 2] and len(ranks) == 3


def test_empty_tables(spark):
    empty = docs(spark, [])
    assert importance.resample(empty, empty).count() == 0
    assert importance.resample(docs(spark, [(1, "a " * 30)]), empty).select("n_features", "rank").first() == (87, None)
