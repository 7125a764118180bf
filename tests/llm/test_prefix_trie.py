import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from helpers import folder, got

from copytrace.llm import prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, rebuilt=True):
    """The nodes, one by one, in plain Python."""
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    paths = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in convs.items()}
    if rebuilt:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in paths}
        paths = {c: paths.get(c - c % 20, [])[: h[c]] + p[h[c] :] for c, p in paths.items()}
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    out = []

    def visit(key, parent):
        mine = members[key]
        leaves, saved = (0 if children[key] else 1), (len(mine) - 1) * (len(WORD.findall(key[-1][1])) if key else 0)
        for child in children[key]:
            more = visit(child, mine[0])
            leaves, saved = leaves + more[0], saved + more[1]
        ends = ",".join(str(c) for c in mine if len(paths[c]) == len(key))
        out.append((mine[0], len(key), parent, len(mine), len(children[key]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        visit((), None)
    return sorted(out, key=repr)


def tree(n, seed, most=14, words=3):
    """Conversations that part from each other at all depths."""
    rng = random.Random(seed)
    rows, known = [], [[]]
    for c in rng.sample(range(4 * n), n):
        start = rng.choice(known)[: rng.randint(0, most)]
        path = start + [(rng.choice(["user", "assistant", None]), " ".join(rng.choice("abc") for _ in range(rng.randint(0, words)))) for _ in range(rng.randint(0, 5))]
        known.append(path)
        rows += [(c, i, r, t) for i, (r, t) in enumerate(path)]
    rng.shuffle(rows)
    return rows


def nodes(df):
    return got(df, *prefix_trie.NODE)


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_brute_force(spark, tmp_path, seed):
    rows = tree(150, seed)
    # Hot copies, null and repeated turns, a null role and text, rows without a conversation.
    rows += [(1000 + 20 * i, t, "user", f"same {t}") for i in range(60) for t in range(9)]
    rows += [(5000, None, "user", "first"), (5000, 3, None, None), (5000, 3, None, None), (5000, 3, "a", "x y"), (None, 1, "user", "nobody")]
    rows += [(5021, 0, "user", "gone"), (-20, 0, "user", "below zero"), (-20, 1, "user", "again")]
    path = folder(tmp_path, spark, conversations=spark.createDataFrame(rows, SCHEMA))
    found = prefix_trie.op12_prefix_trie(spark, path)
    assert found.columns == prefix_trie.NODE
    assert nodes(found) == brute(rows)


def test_without_rebuilding_and_with_small_slices(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLICE", 8)
    monkeypatch.setattr(prefix_trie, "IDS", 2)
    rows = tree(60, 7)
    long = [("user", f"turn {i % 3}") for i in range(70)]
    rows += [(c, i, r, t) for c, end in ((901, 70), (902, 70), (903, 40), (904, 41), (905, 8), (906, 9), (907, 9)) for i, (r, t) in enumerate(long[:end])]
    found = prefix_trie.prefix_trie(*prefix_trie.number_turns(spark.createDataFrame(rows, SCHEMA)))
    assert nodes(found) == brute(rows, rebuilt=False)


def test_turns_only_grouped_where_siblings_diverge(spark):
    # Two conversations share eleven turns and part in the twelfth: only the third block is refined.
    rows = [(c, i, "user", f"turn {i}" if i < 11 else f"own {c}") for c in (1, 2) for i in range(16)]
    turns, convs = prefix_trie.number_turns(spark.createDataFrame(rows, SCHEMA))
    blocks = prefix_trie._blocks(prefix_trie._paths(turns, convs)).withColumn("copies", prefix_trie.F.lit(1))
    distinct = spark.createDataFrame([(1, 1), (2, 1)], "conv long, copies long")
    marked = prefix_trie._mark_blocks(blocks, distinct)
    assert got(marked.where("NOT uniform"), "conv", "depth") == [(1, 12), (2, 12)]
    assert nodes(prefix_trie.prefix_trie(turns, convs)) == brute(rows, rebuilt=False)


def test_extra_columns_and_empty_table(spark, tmp_path):
    rows = [(1, 0, "u", "a b", 5, "x"), (2, 0, "u", "a b", 6, "y")]
    wide = spark.createDataFrame(rows, SCHEMA + ", depth int, conv string")
    assert nodes(prefix_trie.prefix_trie(*prefix_trie.number_turns(wide))) == brute(rows, rebuilt=False)
    path = folder(tmp_path, spark, conversations=spark.createDataFrame([], SCHEMA))
    assert prefix_trie.op12_prefix_trie(spark, path).count() == 0


def test_very_long_text(spark):
    rows = [(1, 0, "u", "word " * 200_000), (2, 0, "u", "word " * 200_000), (3, 0, "u", "word " * 199_999)]
    assert nodes(prefix_trie.prefix_trie(*prefix_trie.number_turns(spark.createDataFrame(rows, SCHEMA)))) == brute(rows, rebuilt=False)
