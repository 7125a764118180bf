import random
from collections import Counter, defaultdict

import pytest
from helpers import docs, folder
from test_language import SYLLABLES, text
from test_line_dedup import key_of
from test_mixing import brute_targets, words
from test_packing import verify
from test_simhash import brute as brute_groups

import corpus_pipeline
from copytrace.llm import language, packing
from copytrace.llm.queries import QUERIES

public = pytest.importorskip("public_tokenizers")
PASSAGE = "a passage that many of the documents share with each other"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(n=160):
    rng = random.Random(12)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES)[:3])
        rows.append((i, "\n".join(text(lang, rng, rng.randint(5, 40)) for _ in range(3)), lang, f"s{i % 4}"))
    for i in range(n, n + 12):
        rows.append((i, f"{rows[i - n][1]}\n{PASSAGE}", rows[i - n][2], "s0"))
    rows += [(1000 + i, rows[5][1], rows[5][2], "s1") for i in range(5)]
    rows += [(2000, None, "aa", "s1"), (2001, "", None, None), (2002, "12345", "aa", "s2"), (2003, PASSAGE, "aa", None), (2004, text("bb", rng, 20_000), "bb", None)]
    return rows


def test_stages(spark, tmp_path):
    rows = corpus()
    path = folder(tmp_path / "in", spark, documents=docs(spark, rows))
    table = spark.read.parquet(f"{path}/documents.parquet")
    seen = [list(map(tuple, table.collect()))]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, path)
        out.write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert table.columns == COLUMNS
        seen.append(table.collect())
    before, identified, lined, single, mixed, pieces = seen

    # Language ID: what is rejected has no letters or two near codewords; texts stay as they are.
    assert {2000, 2001, 2002}.isdisjoint(r.doc_id for r in identified)
    assert set(map(tuple, identified)) <= set(before) and len(identified) >= len(before) - 3 - len(before) // 50
    # Line dedup.
    holders = defaultdict(set)
    for r in identified:
        for line in r.text.split("\n"):
            if len(key_of(line)) >= 40:
                holders[key_of(line)].add(r.doc_id)
    top = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if top.get(key_of(x), r.doc_id) == r.doc_id) for r in identified}
    assert {r.doc_id: r.text for r in lined} == want and all(r.n_chars == len(r.text) for r in lined)
    assert any(PASSAGE in r.text for r in identified) and sum(PASSAGE in r.text for r in lined) == 1
    # Near-dedup: the smallest id of each group stays, with all its columns.
    groups = brute_groups([(r.doc_id, r.text) for r in lined])
    assert {r.doc_id for r in single} == {c for _, _, c in groups} and set(map(tuple, single)) <= set(map(tuple, lined))
    assert len(single) < len(lined)
    # Mixing: whole rows, up to twice, near their source's target.
    counts = Counter(map(tuple, mixed))
    assert max(counts.values()) == 2 and set(counts) <= set(map(tuple, single))
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in single:
        sizes[r.source] += words(r.text)
        taken[r.source] += words(r.text) * counts[tuple(r)]
        largest[r.source] = max(largest[r.source], words(r.text))
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) <= 2 * largest[s]
    # Packing.
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path(packing.VOCABULARY))
    assert verify(pieces, [(r.doc_id, r.text) for r in mixed], library) < 0.05


def test_run_is_the_stages_in_order(spark, tmp_path):
    path = folder(tmp_path, spark, documents=docs(spark, corpus(60)))
    assert QUERIES["pipeline"] is corpus_pipeline.run
    found = corpus_pipeline.run(spark, path)
    assert found.columns == [c.split()[0] for c in packing.PIECES.split(", ")] and found.count() > 0
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, path).collect()))


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(tmp_path, spark, documents=docs(spark, []))).count() == 0


def test_repeated_rows_null_ids_and_extra_columns(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, text("aa" if i % 2 else "bb", rng), "aa" if i % 2 else "bb", "s") for i in range(40)]
    rows += [rows[3]] * 3 + [(None, text("bb", rng), "bb", None)] * 2
    table = docs(spark, rows).selectExpr("*", "1 AS size", "'x' AS `row`", "2 AS id", "3 AS kept", "4 AS fp")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, "")
        assert out.columns == table.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
    assert corpus_pipeline.STAGES[-1][1](spark, table, "").count() > 0
    single = spark.read.parquet(f"{tmp_path}/simhash_dedup")
    assert single.where("doc_id = 3").count() == 1 and single.where("doc_id IS NULL").count() == 2


def test_clean_documents_pass_language_id(spark):
    table = docs(spark, corpus())
    kept = corpus_pipeline.identify_language(spark, table, "")
    lost = {r.doc_id for r in table.join(kept, "doc_id", "left_anti").collect()}
    assert lost <= {2000, 2001, 2002, 2003} and language.UNKNOWN == "und"


def test_rows_that_share_an_id_are_decided_by_their_texts(spark):
    x, b, c = (" ".join(f"{k}{i}" for i in range(50)) for k in "xbc")
    rows = [(3, x), (7, x), (7, b), (9, c), (9, c), (9, f"{c} more"), (None, b), (None, x)]
    kept = corpus_pipeline.dedup_near(spark, docs(spark, rows), "").collect()
    mine = sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None)
    assert mine in (sorted([(3, x), (7, b), (9, t)]) for t in (c, f"{c} more"))
    assert sum(r.doc_id is None for r in kept) == 2
