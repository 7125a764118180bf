import random
import re

import numpy as np
import pytest
import xxhash
from helpers import docs, folder, got

from copytrace.llm import simhash


def brute_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows):
        least[g] = i if least.get(g) is None else (least[g] if i is None else min(i, least[g]))
    return sorted(((i, format(p, "016x"), least[g]) for (i, _), p, g in zip(rows, prints, group)), key=repr)


def near_texts(n, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 999)}" for _ in range(400)]
    rows = []
    for i in range(n):
        words = list(base) if i % 3 else [f"x{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"n{i}"
        rows.append((i, " ".join(words)))
    return rows


CASES = {
    "near": near_texts(80, 1),
    "empty and null": [(5, ""), (2, None), (9, " \t\n"), (7, "one two")],
    "few words": [(1, "a b c"), (2, "A  b\nC"), (3, "a b"), (4, "a")],
    "repeated rows and ids": [(1, "a b c d e"), (1, "a b c d e"), (1, "other words are here now"), (3, "other words are here now")],
    "null ids": [(None, "a b c d e"), (4, "a b c d e"), (None, "alone"), (3, "x y z")],
    "very long": [(i, " ".join(f"word{j % 5000}" for j in range(150_000 + i))) for i in range(2)],
    "other white space is part of words": [(1, "a b c d e f"), (2, "a b c d e f")],
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, tmp_path, name):
    path = folder(tmp_path, spark, documents=docs(spark, CASES[name]))
    assert got(simhash.op5_simhash(spark, path), "doc_id", "fingerprint", "component_id") == brute(CASES[name])


def test_empty_table(spark):
    assert simhash.simhash_components(docs(spark, [])).count() == 0


def roots(nodes, edges):
    group = {n: n for n in nodes}
    for a, b in edges:
        x, y = group[a], group[b]
        group = {n: (x if g == y else g) for n, g in group.items()}
    return {frozenset(n for n in nodes if group[n] == g) for g in set(group.values())}


@pytest.mark.parametrize("chunk", [4, 512])
def test_links_connect_like_all_pairs(spark, monkeypatch, chunk):
    """Also with buckets so large that they are dealt into chunks."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    prints = set()
    for base in rng.integers(0, 2**64, 30, dtype=np.uint64).tolist() + [0]:
        for _ in range(12):
            bits = rng.choice(64, rng.integers(0, 6), replace=False)
            prints.add(base ^ int(sum(1 << int(b) for b in bits)))
    prints = sorted(prints)
    want = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 4]
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    found = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long")).collect()
    links = [(int(np.int64(r.a).astype(np.uint64)), int(np.int64(r.b).astype(np.uint64))) for r in found]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    assert roots(prints, links) == roots(prints, want)


def test_every_bit_pattern_within_reach_shares_a_bucket(spark):
    rng = np.random.default_rng(3)
    pairs = []
    for _ in range(500):
        a = int(rng.integers(0, 2**64, dtype=np.uint64))
        pairs.append((a, a ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))))
    flat = [(k, i, int(np.uint64(p).astype(np.int64))) for k, pair in enumerate(pairs) for i, p in enumerate(pair)]
    keys = spark.createDataFrame(flat, "pair int, side int, fp long").select("pair", "side", simhash._keys().alias("keys")).collect()
    sides = {(r["pair"], r["side"]): set(r["keys"]) for r in keys}
    assert all(sides[k, 0] & sides[k, 1] for k in range(len(pairs)))
