"""Encoding texts piece by piece, for tokenizers whose tokens never cross certain places.

Pieces repeat much more than texts. A batch of texts is cut at its spaces by
Arrow, which also numbers its distinct pieces; only those are looked at one by
one. What they encode to comes from a cache that each worker keeps and bounds,
and every text's result is gathered by numpy from its pieces' numbers.

Unknown pieces go to the tokenizer in batches that are balanced by bytes: plain
words joined to one text, whose tokens are told apart by their word marks, all
others one by one. Closing punctuation after a word is always a token group of
its own, so such a piece is the sum of its word and its punctuation.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 1 << 16
SLICE_BYTES = 4 << 20
CACHE_ENTRIES = 300_000
CACHE_PIECE = 64  # longer pieces are encoded anew each time
# ASCII punctuation but the apostrophe, which can start a contraction.
CLOSING = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

# A space with white space or nothing on both sides; the other spaces are safe to cut at.
_UNSAFE = re.compile(r"(?<!\S) (?!\S)")
_SAFE = re.compile(r"(?<=\S) | (?=\S)")
# The same for Arrow's expressions: all characters that Python's \s matches.
_WHITE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNSAFE_ARROW = rf"(?:\A|{_WHITE}) (?:\z|{_WHITE})"


@dataclass
class Pieces:
    """Texts as numbers of their distinct pieces: text i has ``codes[bounds[i]:bounds[i + 1]]``."""

    entries: list[str]
    codes: np.ndarray
    bounds: np.ndarray

    def totals(self, amounts: list[int]) -> np.ndarray:
        """Sum of the entries' amounts over the pieces of each text."""
        running = np.concatenate(([0], np.cumsum(np.array(amounts, np.int64)[self.codes])))
        return running[self.bounds[1:]] - running[self.bounds[:-1]]

    def joined(self, ids: list[bytes]) -> list[np.ndarray]:
        """The entries' ids (little-endian 32-bit numbers) joined for each text."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
        found, running = gathered(flat, np.concatenate(([0], ends)), self.codes)
        return np.split(found, running[self.bounds[1:-1]]) if len(self.bounds) > 1 else []


def gathered(flat: np.ndarray, bounds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries ``codes`` (entry i has ``flat[bounds[i]:bounds[i + 1]]``) one after the other, and their bounds."""
    begin = bounds[codes]
    many = bounds[codes + 1] - begin
    running = np.concatenate(([0], np.cumsum(many)))
    return flat[np.arange(running[-1]) + np.repeat(begin - running[:-1], many)], running


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All pieces between spaces, and the bounds of each text's."""
    lists = pc.split_pattern(texts, " ")
    return lists.flatten(), np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)


def _numbered(pieces: pa.Array) -> tuple[list[str], np.ndarray]:
    found = pieces.dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy().astype(np.int64)


def cut(texts: pa.Array) -> Pieces:
    """Texts (no nulls) cut at every space; the spaces go."""
    pieces, bounds = _split(texts)
    return Pieces(*_numbered(pieces), bounds)


def cut_safely(texts: pa.Array, whole: str | None = None) -> Pieces:
    """Texts (no nulls) cut before each space that has other than white space on at least one side.

    Byte-level BPE attaches such a space to what follows it, and no token reaches across it. The pieces make up the
    text. A text that holds ``whole`` stays in one piece.
    """
    odd = pc.match_substring_regex(texts, _UNSAFE_ARROW)
    single = pc.match_substring(texts, whole) if whole else pa.array(np.zeros(len(texts), bool))
    special = pc.or_(odd, single).to_numpy(zero_copy_only=False)
    pieces, bounds = _split(pc.if_else(pa.array(special), "", texts))
    entries, codes = _numbered(pieces)
    # Entries stand for a space and the piece; a text's first piece has no space before it.
    first = [pieces[int(i)].as_py() for i in bounds[:-1]]
    codes[bounds[:-1]] = len(entries) + np.arange(len(first))
    entries = [" " + e for e in entries] + first
    if not special.any():
        return Pieces(entries, codes, bounds)
    parts, counts = [], np.diff(bounds)
    for i, (given, alone) in enumerate(zip(special.tolist(), single.to_pylist())):
        if not given:
            parts.append(codes[bounds[i] : bounds[i + 1]])
            continue
        text = texts[i].as_py()
        head, *rest = [text] if alone else _SAFE.split(text) if _UNSAFE.search(text) else text.split(" ")
        parts.append(np.arange(len(entries), len(entries) + 1 + len(rest)))
        entries += [head, *[" " + p for p in rest]]
        counts[i] = 1 + len(rest)
    return Pieces(entries, np.concatenate(parts), np.concatenate(([0], np.cumsum(counts))))


def by_size(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``most`` bytes of text, at least one row each; bounds what is held at once."""
    ends = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(ends):
        before = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(low, high - low)
        low = high


def by_bytes(pieces: Iterable[str]) -> Iterator[list[str]]:
    batch, size = [], 0
    for piece in pieces:
        batch.append(piece)
        size += 4 * len(piece)
        if size >= BATCH_BYTES:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


class Cache:
    """What pieces encode to; one per worker process and vocabulary file."""

    _shared: dict[tuple[type, str], Cache] = {}

    def __init__(self) -> None:
        self.known: dict = {}

    @classmethod
    def shared(cls, path: str):
        if (cls, path) not in Cache._shared:
            Cache._shared[cls, path] = cls(path)
        return Cache._shared[cls, path]

    def learn(self, pieces: set[str]) -> None:
        """Adds all ``pieces`` to ``known``."""
        raise NotImplementedError

    def find(self, entries: list[str]) -> list:
        """What each entry encodes to. Long pieces are forgotten again, and all when they are too many."""
        if len(self.known) > CACHE_ENTRIES:
            self.known = {}
        known = self.known
        unknown = {e for e in entries if e not in known}
        self.learn(unknown)
        found = list(map(known.__getitem__, entries))
        for piece in unknown:
            if len(piece) > CACHE_PIECE:
                del known[piece]
        return found


class PieceCache(Cache):
    """For files of the tokenizers library; subclasses say what is kept of the ids. Kept values of neighbours add up."""

    between = ""  # joins plain words

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.marked = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.marked[number] = self.is_mark(token)

    def value(self, ids: list[int]):
        raise NotImplementedError

    def values(self, ids: np.ndarray, bounds: np.ndarray) -> list:
        """``value`` of every piece of ``ids`` between neighbouring bounds."""
        raise NotImplementedError

    def is_word(self, piece: str) -> bool:
        """Whether the tokenizer takes the piece as one word."""
        raise NotImplementedError

    def is_mark(self, token: str) -> bool:
        """Whether a vocabulary entry shows a word's place: its first token or its last."""
        raise NotImplementedError

    def split(self, ids: np.ndarray) -> np.ndarray:
        """Bounds of the words in the ids of joined words, from 0 to the end."""
        raise NotImplementedError

    def _encode(self, pieces: list[str]) -> None:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        self.known.update((p, self.value(e.ids)) for p, e in zip(pieces, found))

    def _encode_words(self, words: list[str]) -> None:
        (found,) = self.tokenizer.encode_batch_fast([self.between.join(words)], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        bounds = self.split(ids)
        if len(bounds) != len(words) + 1:  # a letter that normalises to more than letters
            return self._encode(words)
        self.known.update(zip(words, self.values(ids, bounds)))

    def learn(self, pieces: set[str]) -> None:
        known, words, others, sums = self.known, set(), set(), []
        for piece in pieces:
            if self.is_word(piece):
                words.add(piece)
            elif (stem := piece.rstrip(CLOSING)) != piece and self.is_word(stem):
                tail = piece[len(stem) :]
                sums.append((piece, stem, tail))
                if stem not in known:
                    words.add(stem)
                if tail not in known:
                    others.add(tail)
            else:
                others.add(piece)
        for batch in by_bytes(words):
            self._encode_words(batch)
        for batch in by_bytes(others):
            self._encode(batch)
        known.update([(piece, known[stem] + known[tail]) for piece, stem, tail in sums])
        for piece in (words | others) - pieces:
            if len(piece) > CACHE_PIECE:
                del known[piece]
