import random

import pytest
from helpers import docs, folder, got

from copytrace.llm import tokens

public = pytest.importorskip("public_tokenizers")
PARTS = ["a", "B", " ", "  ", "   ", "\n", "\t", "'s", "'", "é", "<|endoftext|>", "<|", "1", "23", ".", "!?", " ", "　", "İ", "Σ", "\x1c", "é", "x" * 90, "\r\n", "中文", "ﬁ", "word, ", "word. "]


def test_counts_equal_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    texts = [None, "", " ", "   ", "long text, " * 30_000] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    library = Tokenizer.from_file(public.path(tokens.VOCABULARY))
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in enumerate(texts)]
    path = folder(tmp_path, spark, documents=docs(spark, list(enumerate(texts))))
    assert got(tokens.op6_tokens(spark, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)


def test_small_cache_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr("copytrace.llm.pieces.CACHE_ENTRIES", 3)
    cache = tokens.PieceLengths(public.path(tokens.VOCABULARY))
    texts = ["one two three four five", "one, two. three! four five six", "y" * 300] * 3
    assert [cache.counts([t])[0] for t in texts] == [len(cache.tokenizer.encode(t).ids) for t in texts]


def test_empty_table(spark):
    assert tokens.count_tokens(docs(spark, [])).count() == 0


def test_slices_by_size_hold_every_row():
    import pyarrow as pa

    from copytrace.llm import pieces

    texts = ["a" * 10, "", "b" * 50, "c" * 3, "", "d" * 30, "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(7))], ["text", "id"])
    parts = list(pieces.by_size(batch, "text", 30))
    assert [i for p in parts for i in p.column("id").to_pylist()] == list(range(7)) and len(parts) > 2
    whole = [x for p in parts for x in pieces.cut(p.column("text")).entries]
    assert set(whole) == set(texts) and not list(pieces.by_size(batch.slice(0, 0), "text"))
