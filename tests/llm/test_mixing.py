import hashlib
import math
import re
from collections import defaultdict

import pytest
from helpers import docs, folder, got

from copytrace.llm import mixing


def brute_targets(sizes):
    """Shares by weight, again and again, until no source is above twice its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in above}
        left -= sum(2 * sizes[s] for s in above)
        open_ -= above
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(spark, tmp_path, rows):
    path = folder(tmp_path, spark, documents=docs(spark, rows))
    found = mixing.op4_mixing(spark, path).collect()
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += words(text)
    targets = brute_targets(sizes)
    assert sorted((r.doc_id, r["size"]) for r in found) == sorted((i, words(t)) for i, t, *_ in rows)
    source_of = defaultdict(set)
    for i, _, _, s in rows:
        source_of[i].add(s)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in found:
        assert r["size"] * 2 >= r.taken >= 0 and (r.taken == 0 or r.taken % r["size"] == 0)
        (s,) = source_of[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, targets[s], rel_tol=1e-9, abs_tol=1e-9)
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 2 * largest[s] + 0.02 * t
    again = mixing.op4_mixing(spark, path)
    assert got(again, *again.columns) == sorted(map(tuple, found), key=repr)
    return found


def text(n):
    return " ".join(["w"] * n)


CASES = {
    "several sources": [(i, text(1 + (i * 37) % 50), None, f"s{i % 7}") for i in range(700)],
    "null source, null and empty texts": [(i, None if i % 5 == 0 else text(i % 9), None, None if i % 3 else "a") for i in range(200)],
    "one hot source": [(i, text(10 + i % 3), None, "hot" if i % 10 else f"s{i}") for i in range(400)],
    "one document": [(1, text(7), None, "a")],
    "all empty": [(i, "", None, "a") for i in range(4)],
    "code point order": [(i, text(20), None, ("Z", "a", "é", "\U0001f600", "￮")[i % 5]) for i in range(300)],
    "equal documents": [(i, text(12), None, "ab"[i % 2]) for i in range(300)],
    "very long": [(1, text(400_000), None, "a"), *[(i, text(40), None, "b") for i in range(2, 60)]],
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, tmp_path, name):
    check(spark, tmp_path, CASES[name])


def test_repeated_rows(spark, tmp_path):
    rows = [(i % 40, text(5), None, "a") for i in range(120)]
    assert len(check(spark, tmp_path, rows)) == 120


def test_carry_repeats_rows_with_clashing_columns(spark):
    table = docs(spark, [(i, text(9), None, "ab"[i % 2]) for i in range(60)]).selectExpr("*", "1 AS size", "2 AS id", "3 AS copies", "4 AS `row`", "'x' AS class")
    found = mixing.mix(table, carry=True)
    assert found.selectExpr("row.*").columns == table.columns and found.agg({"copies": "sum"}).first()[0] == 90


def test_empty_table(spark):
    assert mixing.mix(docs(spark, [])).count() == 0


def test_offset_is_the_hash_that_sql_uses(spark):
    got = spark.range(1).select(mixing._offset(mixing.F.lit("a"))).first()[0]
    assert got == int(hashlib.md5(b"mix:a").hexdigest()[:5], 16) / 2**20
