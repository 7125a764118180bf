"""Packing documents into fixed windows by order-preserving dynamic programming.

The token streams of a partition's documents follow each other in the order of
the scan. Cuts may fall at document ends, sentence ends and, as a last resort,
at every ``GRID`` tokens. The dynamic program minimises padding plus a penalty
for each cut inside a sentence or a document, over windows of at most ``WIDTH``
tokens: the cost of ending at a place is its penalty plus the padding from the
best earlier place within reach, kept by a monotone queue. Windows do not cross
partitions; the last remainder of a partition becomes windows of a power of two
tokens, which need no padding, if that is cheaper than one padded window.

The stream is worked off in blocks of ``BLOCK`` tokens; what follows a block's
best last cut waits for the next block, so memory is bounded by a block and the
longest document.

Encoding: no token of the word BPE crosses white space or the border of a run of
letters or punctuation (but after an apostrophe), so texts are cut there by kinds
of bytes, Arrow numbers the distinct words of a slice, only those are looked up in
a bounded cache or encoded, and numpy gathers each text's ids from them.

Defined cases: a null or empty text is its end token alone; equal rows and
rows sharing an id are packed one by one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from itertools import repeat
from string import ascii_letters, ascii_lowercase, ascii_uppercase, digits
from unicodedata import normalize

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copytrace.llm.common import documents, spread, text_of
from copytrace.llm.pieces import BATCH_BYTES, CACHE_ENTRIES, CACHE_PIECE, CLOSING, PieceCache, by_size, gathered

WIDTH = 2048
BLOCK = 1 << 18
GRID = 64
END_ID = 1
# Cost of a cut, in tokens of padding: inside a sentence, at a sentence's end.
CUT_SENTENCE, CUT_DOCUMENT = 24.0, 6.0
VOCABULARY = "word_bpe_49k.json"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# Kinds of bytes: letters (of ASCII and Latin-1), digits, marks (ASCII punctuation but the apostrophe), white space.
KINDS = OTHER, LETTER, DIGIT, MARK, APOSTROPHE, SPACE = range(6)
_CHARS = {LETTER: ascii_letters, DIGIT: digits, MARK: CLOSING, APOSTROPHE: "'", SPACE: " \t\n\r"}
KIND = bytes(next((kind for kind, chars in _CHARS.items() if chr(i) in chars), OTHER) for i in range(256))
LOWER = bytes.maketrans(ascii_uppercase.encode(), ascii_lowercase.encode())
# Neighbours (6 * kind + kind) between which a word starts: not in a run of letters or of punctuation, nor after an apostrophe (``'s``).
_STARTS = {6 * SPACE + b for b in KINDS if b != SPACE} | {6 * a + b for a in KINDS for b in KINDS if DIGIT in (a, b) and not {OTHER, SPACE} & {a, b}}
_STARTS |= {6 * LETTER + MARK, 6 * LETTER + APOSTROPHE, 6 * MARK + LETTER}
_STARTS = bytes(i in _STARTS for i in range(256))
# Lower-case letters of ASCII and Latin-1.
PLAIN = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"


def strings(words: pa.Array) -> list[str]:
    """The words as a list; none holds a space."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(whole, " ")[0].as_py().split(" ") if len(words) else []


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts (no nulls) where the tokenizer's pattern always cuts, without white space, and the bounds of each text's.

    The tokenizer ignores the case of letters, so ASCII and Latin-1 letters become lower-case where no combining mark can
    follow. Special strings are kept: a text with ``<|`` is cut at white space only.
    """
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kind = np.frombuffer(bytearray(data).translate(KIND), np.uint8)
    lower = np.frombuffer(bytearray(data).translate(LOWER), np.uint8)
    lead = np.flatnonzero(data == 0xC3)  # of Latin-1's letters, the multiplication and the division sign
    second = data[lead + 1]
    lower[lead[(second <= 0x9E) & (second != 0x97)] + 1] += 32
    lead = lead[(second != 0x97) & (second != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
    if special.any():
        kind[np.repeat(special, np.diff(ends)) & (kind != SPACE)] = OTHER
    kept = kind == OTHER
    kept[:-1] |= kept[1:]
    np.copyto(lower, data, where=kept)
    between = np.append(np.uint8(SPACE), kind[:-1]) if len(kind) else kind.copy()
    between[ends[:-1][ends[1:] > ends[:-1]]] = SPACE
    between *= 6
    between += kind
    starts = np.frombuffer(bytearray(between).translate(_STARTS), bool)
    solid = kind != SPACE
    at = np.append(np.flatnonzero(starts[solid]), np.count_nonzero(solid)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(lower[solid]))
    return words, np.searchsorted(np.flatnonzero(starts), ends)


class WordIds(PieceCache):
    """Ids of whole texts as little-endian 32-bit numbers.

    Known word i has the ids ``flat[bounds[i] : bounds[i + 1]]``; ``number`` has the i of each.
    """

    between = " "

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer, pre_tokenizers

        # For words that the normalizer leaves as they are and the pattern takes as one.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.number: dict[str, int] = {}
        self.flat, self.bounds = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def value(self, ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def values(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        raw, at = ids.tobytes(), (4 * bounds).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def is_word(self, piece: str) -> bool:
        if piece.isascii():
            return piece.isalpha()
        return piece.isalpha() and normalize("NFC", piece).lower().isalpha()

    def is_mark(self, token: str) -> bool:
        return token.endswith("</w>")

    def split(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.flatnonzero(self.marked[ids]) + 1))

    def _encode_plain(self, words: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of plain words, and their amounts, by batches."""
        ids, many = [], []
        size = np.cumsum(pc.binary_length(words).to_numpy())
        ends = np.unique(np.append(np.searchsorted(size, np.arange(BATCH_BYTES, size[-1], BATCH_BYTES)), len(words)))
        for low, high in zip([0, *ends], ends):
            (found,) = self.plain.encode_batch_fast([" ".join(strings(words.slice(low, high - low)))], add_special_tokens=False)
            ids.append(np.array(found.ids, "<u4"))
            many.append(np.diff(self.split(ids[-1])))
            if len(many[-1]) != high - low:  # a vocabulary without some of the letters
                return self._encode_others(strings(words))
        return ids, many

    def _encode_others(self, pieces: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        self.known = {}
        self.learn(set(pieces))
        raw = [self.known[p] for p in pieces]
        return [np.frombuffer(b"".join(raw), "<u4")], [np.fromiter(map(len, raw), np.int64, len(raw)) // 4]

    def numbers(self, entries: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words, their bounds, and which of them the (distinct) entries are.

        Long entries are forgotten again; when too many are known, only those of the latest call stay.
        """
        words = strings(entries)
        at = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(at < 0)
        given = entries.take(pa.array(unknown))
        plain = pc.match_substring_regex(given, PLAIN).to_numpy(zero_copy_only=False)
        long = pc.greater(pc.utf8_length(given), CACHE_PIECE).to_numpy(zero_copy_only=False)
        ids, many, order = [self.flat], [np.diff(self.bounds)], []
        # The long ones come last, to be cut off again.
        for group in (plain & ~long, ~plain & ~long, plain & long, ~plain & long):
            if not group.any():
                continue
            chosen = unknown[group]
            take = self._encode_plain(entries.take(pa.array(chosen))) if plain[group][0] else self._encode_others([words[i] for i in chosen])
            ids, many = ids + take[0], many + take[1]
            order.append(chosen)
        if not order:
            return self.flat, self.bounds, at
        fresh, kept = np.concatenate(order), len(unknown) - int(long.sum())
        at[fresh] = len(self.number) + np.arange(len(fresh))
        flat, bounds = np.concatenate(ids), np.concatenate(([0], np.cumsum(np.concatenate(many))))
        self.number.update((words[i], n) for i, n in zip(fresh[:kept].tolist(), at[fresh[:kept]].tolist()))
        self.bounds = bounds[: len(self.number) + 1]
        self.flat = flat[: self.bounds[-1]]
        if len(self.number) > CACHE_ENTRIES:
            stay = np.setdiff1d(np.arange(len(words)), fresh[kept:])
            self.number = {words[i]: n for n, i in enumerate(stay.tolist())}
            self.flat, self.bounds = gathered(self.flat, self.bounds, at[stay])
        return flat, bounds, at

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        words, bounds = cut_words(texts)
        found = words.dictionary_encode()
        flat, ends, at = self.numbers(found.dictionary)
        ids, running = gathered(flat, ends, at[found.indices.to_numpy()])
        return np.split(ids, running[bounds[1:-1]])

    def ending(self) -> np.ndarray:
        """Ids of the tokens that end a sentence."""
        return np.array([self.tokenizer.token_to_id(f"{mark}</w>") for mark in ".!?"], np.uint32)


def places(ids: np.ndarray, doc_ends: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a cut may fall, from 0, and their penalties."""
    # Where several kinds of places meet, the lowest penalty counts.
    groups = (
        (np.arange(0, len(ids) + 1, GRID), CUT_SENTENCE),
        (np.flatnonzero(np.isin(ids, ending, kind="table")) + 1, CUT_DOCUMENT),
        (np.append(doc_ends, 0), 0.0),
    )
    at = np.concatenate([g for g, _ in groups])
    cost = np.concatenate([np.full(len(g), c) for g, c in groups])
    order = np.lexsort((cost, at))
    at, cost = at[order], cost[order]
    first = np.concatenate(([True], at[1:] != at[:-1]))
    return at[first], cost[first]


def best_cuts(at: np.ndarray, penalty: np.ndarray, final: bool, width: int = WIDTH) -> list[int]:
    """Cuts of least cost, from 0; the last one is the stream's end only if ``final``.

    cost(j) = penalty(j) + width - at(j) + min over reachable i of (cost(i) + at(i)).
    The queue holds places whose key(i) = cost(i) + at(i) increases: its head is the minimum.
    """
    place, fine = at.tolist(), (penalty + width).tolist()
    key, back = [0.0] * len(place), [0] * len(place)
    queue = deque([0])
    for j in range(1, len(place)):
        reach = place[j] - width
        while place[queue[0]] < reach:
            queue.popleft()
        back[j] = i = queue[0]
        key[j] = k = fine[j] + key[i]
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    cost = (np.array(key) - at).tolist()
    end = len(place) - 1
    first = int(np.searchsorted(at, place[end] - width))
    tail: list[int] = []
    if final:
        # The remainder after place i as windows of a power of two each.
        split = {i: cost[i] + CUT_SENTENCE * ((place[end] - place[i]).bit_count() - 1) for i in range(first, end)}
        best = min(split, key=split.__getitem__, default=end)
        if end and split[best] < cost[end]:
            rest, cut = place[end] - place[best], place[best]
            for power in range(rest.bit_length() - 1, -1, -1):
                if rest >> power & 1:
                    cut += 1 << power
                    tail.append(cut)
            end = best
    else:
        end = min(range(max(first, 1), end + 1), key=cost.__getitem__)
    cuts = [end]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return [place[i] for i in reversed(cuts)] + tail


def _rows(ids: np.ndarray, cuts: np.ndarray, docs: list[tuple], first_sequence: int) -> pd.DataFrame:
    """Pieces up to the last cut; ``docs`` has (id, tokens already out, all tokens, end in ``ids``)."""
    ends = np.array([d[3] for d in docs])
    bounds = np.unique(np.concatenate((cuts, ends[ends < cuts[-1]])))
    starts, stops = bounds[:-1], bounds[1:]
    doc = np.searchsorted(ends, starts, side="right")
    window = np.searchsorted(cuts, starts, side="right") - 1
    total = np.array([d[2] for d in docs])[doc]
    length = stops - starts
    return pd.DataFrame(
        {
            "doc_id": pd.array([docs[i][0] for i in doc], "Int64"),
            "start": total - (ends[doc] - starts),
            "length": length,
            "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, stops)],
            "doc_tokens": total,
            "sequence_id": first_sequence + window,
            "offset": starts - cuts[window],
        }
    )


def pack_stream(docs: Iterator[tuple[int | None, np.ndarray]], ending: np.ndarray, first_sequence: int = 0, block: int = BLOCK) -> Iterator[pd.DataFrame]:
    """Pieces of documents given as (id, token ids)."""
    held_ids, held, waiting = [], [], 0

    def work(final: bool):
        nonlocal held_ids, held, waiting, first_sequence
        ids = np.concatenate(held_ids)
        ends = np.cumsum([len(x) for x in held_ids])
        known = [(d, 0, n, int(e)) for (d, n), e in zip(held, ends)]
        at, penalty = places(ids, ends, ending)
        cuts = np.array(best_cuts(at, penalty, final))
        rows = _rows(ids, cuts, known, first_sequence)
        first_sequence += len(cuts) - 1
        done = int(cuts[-1])
        keep = int(np.searchsorted(ends, done, side="right"))
        rest = ids[done:]
        left = np.split(rest, ends[keep:-1] - done) if len(rest) else []
        held_ids, held, waiting = left, held[keep:], len(rest)
        return rows

    for doc, ids in docs:
        held_ids.append(ids)
        held.append((doc, len(ids)))
        waiting += len(ids)
        if waiting >= block:
            yield work(False)
    if waiting:
        yield work(True)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``path``: vocabulary file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.shared(path)
        end = np.array([END_ID], "<u4")

        def encoded():
            for batch in batches:
                for part in by_size(batch, "text"):
                    for doc, ids in zip(part.column("id").to_pylist(), words.ids(part.column("text"))):
                        yield doc, np.concatenate((ids, end))

        for rows in pack_stream(encoded(), words.ending(), TaskContext.get().partitionId() << 36):
            yield pa.RecordBatch.from_pandas(rows, preserve_index=False)

    source = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id")
    return source.select("id", text_of("text").alias("text")).mapInArrow(run, PIECES)


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document."""
    return pack(documents(spark, folder))
