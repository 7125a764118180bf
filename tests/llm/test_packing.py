import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from helpers import docs

from copytrace.llm import packing

public = pytest.importorskip("public_tokenizers")


def least_cost(at, penalty, width):
    """Plain quadratic recurrence over the same places; the stream's end is a cut."""
    cost = [0.0] + [np.inf] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            if at[j] - at[i] <= width:
                cost[j] = min(cost[j], cost[i] + width - (at[j] - at[i]) + penalty[j])
    return cost


def paid(cuts, at, penalty, width):
    fine = dict(zip(at.tolist(), penalty.tolist()))
    total = 0.0
    for a, b in zip(cuts, cuts[1:]):
        n = b - a
        total += 0 if n & (n - 1) == 0 and n < width else width - n
        total += fine.get(b, packing.CUT_SENTENCE)
    return total


@pytest.mark.parametrize("seed", range(20))
def test_cuts_are_optimal(seed):
    rng = np.random.default_rng(seed)
    width = 32
    at = np.unique(np.concatenate(([0], rng.integers(1, 400, 120), np.arange(0, 400, 8), [400])))
    penalty = rng.choice([0.0, 6.0, 24.0], len(at))
    penalty[-1] = 0.0
    want = least_cost(at, penalty, width)
    cuts = packing.best_cuts(at, penalty, True, width)
    assert cuts[0] == 0 and cuts[-1] == 400 and all(0 < b - a <= width for a, b in zip(cuts, cuts[1:]))
    assert paid(cuts, at, penalty, width) <= want[-1] + 1e-9
    open_end = packing.best_cuts(at, penalty, False, width)
    assert open_end[-1] >= 400 - width and abs(paid(open_end, at, penalty, width) - want[at.tolist().index(open_end[-1])]) < 1e-9


def verify(pieces, texts_of, library):
    """Every id of every document lies in exactly one piece, windows are gapless and at most the width."""
    ids_of = defaultdict(list)
    for doc, text in texts_of:
        ids_of[doc].append(np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
    windows = defaultdict(list)
    found = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append(p)
        found[p.doc_id].append(p)
    for doc, versions in ids_of.items():
        assert sum(p.length for p in found[doc]) == sum(map(len, versions))
        if len(versions) == 1:
            at = 0
            for p in sorted(found[doc], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(versions[0])
                assert p.ids_crc32 == zlib.crc32(versions[0][at : at + p.length].tobytes())
                at += p.length
    padding = total = 0
    for rows in windows.values():
        at = 0
        for p in sorted(rows, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= packing.WIDTH
        total += at
        padding += 0 if at & (at - 1) == 0 else packing.WIDTH - at
    return padding / max(total, 1)


def test_round_trip(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path(packing.VOCABULARY))
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéΣİ中") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ",", ".", "'s", "!?", "\n", "́"])
    rows = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 50, 900])))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "x" * 20_000), (903, "no sentence end " * 20_000), (904, "A <|endoftext|> B <|ENDOFTEXT|>"), (905, "\x1c a　b c")]
    pieces = packing.pack(docs(spark, rows)).collect()
    assert verify(pieces, rows, library) < 0.02


def test_repeated_rows_and_null_ids(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path(packing.VOCABULARY))
    rows = [(1, "same text."), (1, "same text."), (None, "no id"), (2, "same text.")]
    pieces = packing.pack(docs(spark, rows)).collect()
    assert len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces)
    verify(pieces, rows, library)


def test_blocks_join_up():
    rng = np.random.default_rng(5)
    given = [(i, rng.integers(0, 1000, rng.integers(1, 5000)).astype("<u4")) for i in range(200)]
    found = pd.concat(packing.pack_stream(iter(given), np.array([3, 4, 5]), 70, block=20_000))
    assert found.length.sum() == sum(len(x) for _, x in given)
    sums = found.groupby("sequence_id").length.sum()
    assert sums.max() <= packing.WIDTH and sums.index.min() == 70
    for (doc, ids), (_, rows) in zip(given, found.groupby("doc_id")):
        at = 0
        for p in rows.itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length


def test_empty_table(spark):
    assert packing.pack(docs(spark, [])).count() == 0


def test_words_are_cut_where_the_pattern_cuts():
    texts = ["Été,l'été.  X12!?\n", "", "a <|endoftext|>,B\tc", "H\u0331,I"]
    words, bounds = packing.cut_words(pa.array(["left out", *texts]).slice(1))
    found = [words[a:b].to_pylist() for a, b in zip(bounds, bounds[1:])]
    # Capitals before a combining mark stay: the library composes before it lowers.
    assert found == [["été", ",", "l", "'été", ".", "x", "1", "2", "!?"], [], ["a", "<|endoftext|>,B", "c"], ["H\u0331,", "i"]]


# With few known words they are forgotten between the slices.
@pytest.mark.parametrize("known", [5, 300, 300_000])
def test_ids_of_any_characters(known, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE_ENTRIES", known)
    library = Tokenizer.from_file(public.path(packing.VOCABULARY))
    words = packing.WordIds(public.path(packing.VOCABULARY))
    rng = random.Random(known)
    parts = [*"abHTWYJzé ÉßÿŸ×÷ØİıŁΣςЖ中ªµ½', .<>=!|&%-_0129  \n\t\r\x0b\x1c\x85\xa0\u0331\u0308\u030a\u030c\u0338\u0327🙂＜\u212a\u1fef\u037eक़각"]
    parts += ["'s", "'T", "'re", "'LL", "the", "and", "...", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "x" * 70, "É" * 40, "Ж" * 70]
    for _ in range(8):
        texts = ["".join(rng.choices(parts, k=rng.choice([0, 1, 2, 3, 8, 30, 200]))) for _ in range(300)]
        found = [x.tolist() for x in words.ids(pa.array(texts))]
        assert found == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert len(words.number) == len(words.bounds) - 1 and words.bounds[-1] == len(words.flat)
        assert max(map(len, words.number)) <= packing.CACHE_PIECE


def test_capital_with_a_combining_mark():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path(packing.VOCABULARY))
    words = packing.WordIds.shared(public.path(packing.VOCABULARY))
    for text in ["H\u0331x", "T\u0308", "W\u030a", "Y\u030a", "J\u030c", "h\u0331", "E\u0301"]:
        assert words.ids(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_word_is_encoded_once():
    """Whatever its case and the punctuation around it, also when it comes again in a later batch."""
    words = packing.WordIds(public.path(packing.VOCABULARY))
    encoded = []
    plain, others = words._encode_plain, words._encode_others
    words._encode_plain = lambda w: encoded.extend(w.to_pylist()) or plain(w)
    words._encode_others = lambda p: encoded.extend(p) or others(p)
    words.ids(pa.array(["Énergie energy, ENERGY. (energy) énergie!!!", "energy|energy"]))
    words.ids(pa.array(["ÉNERGIE; Energy7"]))
    assert sorted(encoded) == sorted(["énergie", "energy", ",", ".", "(", ")", "!!!", "|", ";", "7"])
