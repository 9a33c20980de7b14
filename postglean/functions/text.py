"""Text functions: one form of text, tokens, set similarity, phrase and tactic scores, entropy."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from .arrow import arrow_function

# Confusable letters and digits with the letter they are folded to; the two ligatures give two letters.
CONFUSABLES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ӏ": "l",
    "м": "m", "н": "h", "к": "k", "в": "b", "т": "t", "г": "r", "з": "3",
    "ο": "o", "ρ": "p", "α": "a", "ε": "e", "ι": "i", "ν": "v", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "β": "b", "η": "n", "μ": "m", "σ": "o",
    "ı": "i", "ł": "l", "ø": "o", "0": "o", "1": "l", "3": "e", "5": "s",
}
LIGATURES = {"æ": "ae", "œ": "oe"}
ZERO_WIDTH = "[​‌‍﻿⁠­]"
BIDI = "[‪-‮⁦-⁩]"
STOPWORDS = (
    "the", "a", "an", "to", "of", "and", "or", "for", "in", "on", "at", "is", "are", "your", "you", "we", "our", "this", "that", "with",
    "from", "re", "fw", "fwd", "please", "hello", "hi", "dear",
)
LINK_STOPWORDS = (*STOPWORDS, "here", "https", "http", "www", "com", "net", "org")
PHRASES = (("update your account", 0.85), ("urgent wire", 0.90), ("verify your identity", 0.88))
NO_PHRASE = 0.1
TACTICS = (("urgency", ("urgent", "immediately"), 0.9), ("authority", ("ceo", "boss"), 0.8), ("credential_request", ("verify", "login"), 0.95), ("financial", ("wire", "invoice"), 0.85))


def text_or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


@arrow_function("string")
def nfkc(x: pd.Series) -> pd.Series:
    """NFKC form; plain ASCII is passed through."""
    return x.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def fold_confusables(x: Column, limit: int | None = None) -> Column:
    """Confusables replaced in texts with a non-ASCII character; others unchanged. With a ``limit`` longer texts are cut to it."""
    cut = x if limit is None else F.substring(x, 1, limit)
    mapped = F.translate(cut, "".join(CONFUSABLES), "".join(CONFUSABLES.values()))
    for a, b in LIGATURES.items():
        mapped = F.replace(mapped, F.lit(a), F.lit(b))
    return F.when(cut.rlike(r"[^\x00-\x7F]"), mapped).otherwise(cut)


def normalize_text(x: Column) -> Column:
    """NFKC, zero-width and bidirectional marks dropped, confusables folded, white space single; null gives ''."""
    marks = F.regexp_replace(F.regexp_replace(nfkc(text_or_empty(x)), ZERO_WIDTH, ""), BIDI, "")
    return F.regexp_replace(F.regexp_replace(fold_confusables(marks), r"(?U)\s+", " "), "^ | $", "")


def tokens(x: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Words in order: letters and digits of white-space pieces in lower case, without stop words and those under 3."""
    pieces = F.split(F.regexp_replace(F.lower(text_or_empty(x)), "_", " "), r"(?U)\s+")
    return F.filter(F.transform(pieces, lambda p: F.regexp_replace(p, r"[^\p{L}\p{N}]", "")), lambda w: (F.length(w) > 2) & ~w.isin(*stopwords))


def token_set(x: Column, stopwords: tuple[str, ...] = LINK_STOPWORDS) -> Column:
    return F.array_distinct(tokens(x, stopwords))


def token_bag(x: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Map of word to count."""
    own = tokens(x, stopwords)
    return F.map_from_entries(F.transform(F.array_distinct(own), lambda w: F.struct(w, F.size(F.filter(own, lambda v: v == w)))))


def jaccard(a: Column, b: Column) -> Column:
    """Common elements by elements in either; two empty sets are alike, one empty set is not."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Part of the distinct elements of a that b has; 1 for an empty a."""
    return F.when(F.size(a) == 0, 1.0).when(F.size(b) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a)))


def phrase_probability(x: Column) -> Column:
    """First phrase of ``PHRASES`` contained in the lower-case text decides; null reads as ''."""
    low = F.lower(text_or_empty(x))
    return reduce(lambda w, p: w.when(low.contains(p[0]), p[1]), PHRASES[1:], F.when(low.contains(PHRASES[0][0]), PHRASES[0][1])).otherwise(NO_PHRASE)


def tactic(x: Column, name: str) -> Column:
    """Score of one of ``TACTICS``: its value if a marker is contained in the lower-case text, else 0."""
    low = F.lower(text_or_empty(x))
    _, marks, value = next(t for t in TACTICS if t[0] == name)
    return F.when(reduce(lambda a, b: a | b, [low.contains(m) for m in marks]), value).otherwise(0.0)


def entropy(x: Column) -> Column:
    """Shannon entropy over characters in bits; 0 for null and empty texts."""
    chars = F.split(text_or_empty(x), "")
    n = F.length(text_or_empty(x)).cast("double")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
    return F.when(n > 0, -F.aggregate(counts, F.lit(0.0), lambda s, p: s + p * F.log2(p))).otherwise(0.0)


_EMBED = re.compile(r"[a-z0-9@._\-]+")


@arrow_function("array<float>")
def hash_embedding(x: pd.Series) -> pd.Series:
    """768 signed buckets of token hashes, of length 1; a text without tokens is the zero vector."""

    def one(text: str | None) -> np.ndarray:
        v = np.zeros(768, np.float32)
        for t in _EMBED.findall((text or "").lower()):
            h = hashlib.blake2b(t.encode(), digest_size=8).digest()
            v[int.from_bytes(h[:4], "little") % 768] += 1.0 if h[4] & 1 else -1.0
        norm = float(np.linalg.norm(v))
        return v / norm if norm else v

    return x.map(one)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays of one length; 0 when one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.when((size(a) > 0) & (size(b) > 0), dot / (size(a) * size(b))).otherwise(0.0)
