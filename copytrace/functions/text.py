"""Text column expressions. No Python runs on the executors here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware regex treats as whitespace.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WORD_OR_SPACE = r"[^\p{L}\p{N}_\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TOKEN = r"[\p{L}\p{N}_]{2,}"
SENTENCE_BREAK = r"(?<=[.!?])" + SPACE + "+"

# Punctuation stripped from a word before counting distinct words.
WORD_EDGE = ".,!?;:\"'()"
WORDS_PER_MINUTE = 200


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def clean(text: Column) -> Column:
    """Lower case, punctuation to blanks, single blanks, no outer blanks."""
    spaced = F.regexp_replace(F.lower(text), NOT_WORD_OR_SPACE, " ")
    return F.btrim(F.regexp_replace(spaced, SPACE + "+", " "))


def sentences(text: Column) -> Column:
    """Split after ``. ! ?`` followed by whitespace; blank text gives []."""
    return F.filter(F.split(strip(text), SENTENCE_BREAK), lambda s: s != "")


def words(text: Column) -> Column:
    """Whitespace-separated words, punctuation kept."""
    return F.filter(F.split(strip(text), SPACE + "+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-cased word runs of at least two characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def bigrams(toks: Column) -> Column:
    # zip the list with itself shifted by one; the last, unpaired entry goes.
    shifted = F.slice(toks, F.lit(2), F.greatest(F.size(toks) - 1, F.lit(0)))
    head = F.slice(toks, F.lit(1), F.greatest(F.size(toks) - 1, F.lit(0)))
    return F.zip_with(head, shifted, lambda a, b: F.concat(a, F.lit(" "), b))


def ngrams(toks: Column, n: int) -> Column:
    if n == 1:
        return toks
    if n == 2:
        return F.concat(toks, bigrams(toks))
    raise ValueError("n must be 1 or 2")


def word_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def jaccard(set_a: Column, set_b: Column) -> Column:
    """Overlap of two duplicate-free arrays; 0 when both are empty."""
    shared = F.size(F.array_intersect(set_a, set_b))
    union = F.size(set_a) + F.size(set_b) - shared
    return F.when(union == 0, F.lit(0.0)).otherwise(shared / union)


# Words that name a class in a model's own label list; earlier classes win.
LABEL_WORDS = {"ai": ("fake", "ai", "machine", "generated"), "human": ("real", "human")}


def label_class(label: Column) -> Column:
    """Map a classifier's own label name to ``ai`` / ``human`` (null if neither)."""
    name = F.lower(label)
    return F.coalesce(*[F.when(name.rlike("|".join(words)), label_name) for label_name, words in LABEL_WORDS.items()])
