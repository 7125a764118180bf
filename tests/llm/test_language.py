import random
import zlib

import numpy as np
import pytest
from helpers import docs, folder

from copytrace.llm import language

SYLLABLES = {"aa": "the and ing tion er on", "bb": "der und ich ung ein schen", "cc": "que los ción ado ente", "dd": "ый ого что ение ств"}


def text(lang, rng, words=30):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(words))


def table(n, seed=1, langs=tuple(SYLLABLES)):
    rng = random.Random(seed)
    return [(i, text(lang := rng.choice(langs), rng), lang) for i in range(n)]


def test_held_out_accuracy(spark, tmp_path):
    rows = table(600)
    odd = [(9001, None, "aa"), (9002, "12 !? 3", "aa"), (9003, "", None), (9004, text("bb", random.Random(2)), None), (9005, text("cc", random.Random(3), 40_000), "aa"), (9004, rows[0][1], None)]
    path = folder(tmp_path, spark, documents=docs(spark, rows + odd))
    found = language.op10_language(spark, path).collect()
    assert len(found) == len(rows) + len(odd)
    lang = {r[0]: r[2] for r in rows}
    held = [r for r in found if r.held_out and r.doc_id in lang]
    assert held and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (9001, 9002, 9003))
    assert by_id[9005].lang_pred == "cc"


def test_only_learnable_rows_are_learned_from(spark, tmp_path):
    """Wrong labels on held-out rows change nothing."""
    rows = table(300)
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    a = language.op10_language(spark, folder(tmp_path / "a", spark, documents=docs(spark, rows)))
    b = language.op10_language(spark, folder(tmp_path / "b", spark, documents=docs(spark, wrong)))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("langs, want", [((), "und"), (("bb",), "bb")])
def test_no_or_one_language(spark, langs, want):
    train = docs(spark, table(40, langs=langs) if langs else [(1, "some text", None)])
    model = language.learn(train, ~language.held_out())
    (r,) = language.predict(docs(spark, [(1, "whatever it is")]), model).collect()
    assert r.lang_pred == want and r.score == (1.0 if langs else 0.0)


@pytest.mark.parametrize("k", [2, 3, 4, 7, 8, 40])
def test_codewords_differ(k):
    code = language.codewords(k)
    assert len(np.unique(code, axis=0)) == k == len(code) and set(np.unique(code)) == {-1.0, 1.0}
    gaps = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
    assert min(gaps) >= (1 if k == 2 else 2)
    assert all(len(set(bit)) == 2 for bit in code.T)  # every bit tells some languages apart


def test_ambiguous_text_is_flagged():
    rng = random.Random(8)
    vectors = np.stack([language.counts_of(text(lang, rng)) for lang in SYLLABLES for _ in range(60)])
    model = language.fit_codes(list(SYLLABLES), vectors, np.repeat(np.arange(4), 60))
    best, score, near = model.decode(vectors)
    assert (best == np.repeat(np.arange(4), 60)).mean() > 0.99 and near.mean() < 0.02
    blank = model.decode(np.zeros((1, language.SLOTS), np.float32))
    assert score.min() > blank[1][0]


def test_empty_table_and_clashing_columns(spark):
    assert language.predict(docs(spark, []), None).count() == 0
    odd = docs(spark, table(5)).selectExpr("*", "1 AS score", "2 AS lang_pred", "3 AS p", "4 AS `row`")
    found = language.predict(odd, None)
    assert found.selectExpr("row.*").columns == odd.columns and found.count() == 5
