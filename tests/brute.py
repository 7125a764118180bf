"""Plain-Python TF-IDF used to check the Spark operators on small inputs."""

import math
import re
from collections import Counter


def sentences(text):
    return [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]


def grams(text, n):
    t = re.findall(r"\w{2,}", text.lower())
    return t + ([f"{a} {b}" for a, b in zip(t, t[1:])] if n == 2 else [])


def fit(texts, n):
    df = Counter(g for t in texts for g in set(grams(t, n)))
    return {g: math.log((1 + len(texts)) / (1 + c)) + 1 for g, c in df.items()}


def vector(text, idf, n):
    v = {g: c * idf[g] for g, c in Counter(grams(text, n)).items() if g in idf}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {g: x / norm for g, x in v.items()} if norm else {}


def dot(a, b):
    return sum(x * b[g] for g, x in a.items() if g in b)


def best(scores, k):
    """(key, score) pairs with positive score, best first, ties by key."""
    kept = [(key, s) for key, s in scores if s > 0]
    return sorted(kept, key=lambda p: (-round(p[1], 9), p[0]))[:k]
