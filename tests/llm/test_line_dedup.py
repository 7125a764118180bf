import hashlib
import random
from collections import defaultdict

import pytest
from helpers import docs, folder, got

from copytrace.llm import line_dedup

SPACES = " \t\n\x0b\x0c\r"
LONG = "This line is long enough to count as a passage"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def brute(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= min_chars:
                holders[key_of(line)].add(i)
    order = lambda i: (i is not None, i or 0)
    top = {k: max(v, key=order) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if top.get(key_of(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, tmp_path, rows):
    path = folder(tmp_path, spark, documents=docs(spark, rows))
    return got(line_dedup.op8_line_dedup(spark, path), "doc_id", "n_lines", "n_dropped", "kept_sha256")


CASES = {
    "shared": [(i, f"own {i}\n  {LONG.upper() if i % 2 else LONG}\t\nend") for i in range(7)],
    "four documents keep": [(i, LONG) for i in range(4)],
    "repeats in the largest stay": [(i, f"{LONG}\n{LONG}\n") for i in range(5)],
    "repeats in one document count once": [(1, "\n".join([LONG] * 9)), (2, LONG)],
    "39 and 40 code points": [(i, "é" * 39 + "\n" + "é" * 40) for i in range(6)],
    "null, empty, repeated ids, null ids": [(1, None), (2, ""), *[(3, LONG)] * 6, (None, LONG), (None, LONG), (4, LONG), (5, LONG)],
    "null id is lowest": [(None, LONG), *[(i, LONG) for i in range(-4, 0)]],
    "very long": [(i, "\n".join(f"{LONG} number {j}" for j in range(3000))) for i in range(5)],
    "other line ends stay": [(i, f"a\r\n{LONG}\r\nb") for i in range(5)],
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, tmp_path, name):
    assert run(spark, tmp_path, CASES[name]) == brute(CASES[name])


def test_random(spark, tmp_path):
    rng = random.Random(4)
    pool = [f"{LONG} {i}" for i in range(12)] + ["short", "", "  "]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 6)))) for i in range(120)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    table = docs(spark, []).selectExpr("doc_id", "text", "1 AS h", "2 AS drops", "3 AS `row`", "4 AS id", "5 AS lines")
    assert line_dedup.drop_lines(table).count() == 0
    table = docs(spark, CASES["shared"]).selectExpr("doc_id", "text", "1 AS h", "2 AS drops", "3 AS `row`", "4 AS id", "5 AS lines")
    found = line_dedup.drop_lines(table)
    assert found.selectExpr("row.*").columns == table.columns and found.where("n_dropped = 1").count() == 6


def test_many_lines_in_one_document(spark):
    """Two hundred thousand lines take seconds: nothing compares a line with all others of its document."""
    import time

    shared = [f"a line of forty characters or more that is number {i}" for i in range(200_000)]
    rows = [(i, "\n".join(["short", *shared, f"{i}", shared[0]])) for i in range(5)]
    start = time.perf_counter()
    found = line_dedup.drop_lines(docs(spark, rows)).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert time.perf_counter() - start < 60
    want = {i: ("\n".join(["short", f"{i}"]) if i < 4 else rows[4][1]) for i in range(5)}
    assert {r["doc_id"]: r["kept"] for r in found} == want
    assert {r["n_dropped"] for r in found if r["doc_id"] < 4} == {200_001} and {r["n_lines"] for r in found} == {200_003}


def test_null_and_repeated_ids_lie_apart(spark):
    line = "x" * 50
    rows = [(None, f"{line}\n{i}") for i in range(300)] + [(7, f"{line}\nseven {i}") for i in range(300)] + [(i, line) for i in (1, 2, 3)]
    found = line_dedup.drop_lines(docs(spark, rows)).select("row.doc_id", "kept", "n_dropped").collect()
    kept = sorted((r["doc_id"] is None, r["kept"]) for r in found)
    want = [(True, str(i)) for i in range(300)] + [(False, f"{line}\nseven {i}") for i in range(300)] + [(False, "")] * 3
    assert kept == sorted(want)
