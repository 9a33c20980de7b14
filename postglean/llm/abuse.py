"""Abusive, hateful or sexual content: a score per document by non-negative positive-unlabelled learning.

A document is as abusive as its worst sentence. A linear scorer over words and word pairs of sentences is fitted from all
confirmed positive documents and all documents as unlabelled ones, by the class-prior-corrected risk whose negative part is
kept from falling below zero. The class prior is estimated from the scores of all rows of both and estimated again after
each round of steps, until it stays. Texts are parsed once (:func:`read`); tasks count terms, sum gradients and tell how
scores spread, and only these sums reach the driver.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import met, shared_folder, stored
from .sampling import by_hash

LEAST_DOCS, STEPS, RATE, PENALTY, SHRINK, SHARP = 3, 30, 0.02, 1e-5, 2.0, 2.0
#: Rounds of ``STEPS`` steps at most, relative change of the prior that ends them, and its bounds.
ROUNDS, STAYS, PRIORS = 12, 0.02, (0.002, 0.5)
#: Unlabelled rows that a step sees at least; a round of ``STEPS`` steps sees each of them equally often.
SLICE_ROWS = 6_000
#: Width of the bins in which scores before the sigmoid are counted, and the unit in which tasks sum: the order of sums changes nothing.
BIN, UNIT = 1e-3, 2.0**-36
#: Characters parsed and words worked on together, white-space pieces whose words a task remembers, terms a task counts before it hands them on.
CHUNK, PIECE, KEPT, COUNTED = 2_000_000, 1_000_000, 300_000, 2_000_000
#: Rated documents whose ids are broadcast, and terms of all rows up to which the steps run on the driver (with the same sums).
MET, NEAR = 1_000_000, 4_000_000
#: Tasks whose sums the driver adds up itself.
FEW = 12
ENDS = re.compile(r"[.?!…][\"”»’']?\s+")
# Signs written in place of letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "€": "e", "!": "i"})
WORD = re.compile(r"(?:[^\W_]|[$@](?=\w))(?:[\w*@$€]|[!](?=\w))*[\w*$]|[^\W_]|[“”«»\"„]|^\s*[>|]+")
SPACED = re.compile(r"(?<![\w])(?:[^\W\d_][-. _*]){3,}[^\W\d_](?!\w)")


def sentences(text: str) -> list[str]:
    """Sentences and lines; a quotation that closes before another opens is not broken at the sentence ends inside it."""
    parts: list[str] = []
    for line in text.split("\n"):
        at = 0
        for m in ENDS.finditer(line):
            parts.append(line[at : m.end()])
            at = m.end()
        parts.append(line[at:])
    parts = [p for x in parts if (p := x.strip())]
    if "“" not in text and "«" not in text:
        return parts
    out, i = [], 0
    while i < len(parts):
        end = i
        for opens, closes in ("“”", "«»"):
            if parts[i].count(opens) > parts[i].count(closes):
                for k in range(i + 1, len(parts)):
                    first, last = parts[k].find(opens), parts[k].find(closes)
                    if last >= 0 and (first < 0 or last < first):
                        end = max(end, k)
                        break
                    if first >= 0:
                        break
        out.append(" ".join(parts[i : end + 1]))
        i = end + 1
    return out


_FORMAT = frozenset(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cf")


def plain(text: str) -> str:
    """Lower case, compatibility forms and invisible characters gone, spelled-out words put together."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        if not _FORMAT.isdisjoint(text):
            text = "".join(c for c in text if c not in _FORMAT)
    return SPACED.sub(lambda m: re.sub(r"[-. _*]", "", m[0]), text).lower()


def _read(piece: str) -> tuple[str, ...]:
    """Words of a piece without white space; letters are restored from signs, a masked word keeps its first letter and a mark."""
    bare = piece.strip(".,;:?!()'-")
    if bare.isalpha():  # what the pattern finds, too
        return (bare,)
    out = []
    for w in WORD.findall(piece):
        if "*" in w:
            w = w[0] + "*"
        elif not w.isalpha():
            if any(c.isalpha() for c in w):
                w = w if re.fullmatch(r"[a-z]?\d+", w) else w.translate(LEET)
            else:
                w = "#" if w.isdigit() else w.strip() or w
        out.append(w)
    return tuple(out)


class Words:
    """Words of sentences; those of each different piece are read once and kept, ``KEPT`` pieces at most."""

    def __init__(self, make=tuple):
        self.make = make
        self.first: dict = {}
        self.later: dict = {}

    def __call__(self, sentence: str) -> list:
        pieces = sentence.split()
        if not pieces:
            return []
        got = list(map(self.later.get, pieces))
        got[0] = self.first.get(pieces[0])
        if None in got:
            for k, piece in enumerate(pieces):
                if got[k] is None:
                    known = self.later if k else self.first
                    if len(known) >= KEPT:
                        known.clear()
                    own = _read("x " + piece)[1:] if k and piece[0] in ">|" else _read(piece)  # marks of quoting count at the beginning only
                    got[k] = known[piece] = self.make(own)
        return list(chain.from_iterable(got))


words = Words()


def hashed(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of word pairs from the hashes of their words."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    y = b.astype(np.uint64)
    x ^= (x >> np.uint64(31)) + (y ^ (y >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x *= np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


class Parsed:
    """Documents as sentences as hashed words, in flat arrays: words, words of each sentence, sentences of each document."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, counts: np.ndarray):
        self.flat, self.lengths, self.counts = flat, lengths, counts

    @classmethod
    def of(cls, texts: list[str | None], read: Words) -> Parsed:
        flat, lengths, counts = [], [], []
        for t in texts:
            own = sentences(plain(t)) if t else []
            counts.append(len(own))
            for s in own:
                ids = read(s)
                lengths.append(len(ids))
                flat += ids
        return cls(np.array(flat, np.int64), np.array(lengths, np.int64), np.array(counts, np.int64))

    @classmethod
    def pieces(cls, batch: pa.RecordBatch, of: str = "words") -> Iterator[tuple[pa.RecordBatch, Parsed]]:
        """Rows of a batch with ``of`` and ``lengths``, about ``PIECE`` words at a time."""
        sizes = np.diff(_offsets(batch.column(of)))
        part = (np.cumsum(sizes) - sizes) // PIECE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if i < j:
                b = batch.slice(i, j - i)
                yield b, cls(_flat(b.column(of)), _flat(b.column("lengths")).astype(np.int64), np.diff(_offsets(b.column("lengths"))))

    def terms(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of words and of word pairs, and the sentence of each."""
        owner = np.repeat(np.arange(len(self.lengths)), self.lengths)
        both = np.flatnonzero(owner[1:] == owner[:-1])
        return np.concatenate([self.flat, paired(self.flat[both], self.flat[both + 1])]), np.concatenate([owner, owner[both]])

    def documents(self) -> np.ndarray:
        """The document of each sentence."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def _offsets(lists: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType, there: np.ndarray | None = None) -> pa.Array:
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(flat, kind), mask=None if there is None else pa.array(~there))


class Vocabulary:
    """Numbers of known terms, by their hashes: a table of slots, at most seven in ten filled; a taken one leads to the next."""

    def __init__(self, keys: np.ndarray):
        self.size = len(keys)
        n = 1 << max(int(1.43 * len(keys)).bit_length(), 4)
        self.keys, self.numbers = np.zeros(n, np.int64), np.full(n, -1, np.int32)
        todo, at = np.arange(len(keys)), keys & (n - 1)
        while len(todo):
            free = np.flatnonzero(self.numbers[at] < 0)
            self.numbers[at[free]] = todo[free]  # of several the last stays
            placed = self.numbers[at] == todo
            self.keys[at[placed]] = keys[todo[placed]]
            todo, at = todo[~placed], (at[~placed] + 1) & (n - 1)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known among these hashes, and their numbers."""
        todo, at = np.arange(len(h)), h & (len(self.keys) - 1)
        places, numbers = [], []
        while len(todo):
            number, same = self.numbers[at], self.keys[at] == h[todo]
            hit = np.flatnonzero(same & (number >= 0))
            places.append(todo[hit])
            numbers.append(number[hit])
            on = np.flatnonzero(~same & (number >= 0))
            todo, at = todo[on], (at[on] + 1) & (len(self.keys) - 1)
        return np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int64), *numbers])

    def bags(self, parsed: Parsed) -> Bags:
        """Sentences as sets of numbers of known terms."""
        h, owner = parsed.terms()
        place, number = self.find(h)
        once = owner[place] * max(self.size, 1) + number
        once.sort()
        once = once[np.flatnonzero(np.diff(once, prepend=-1))]
        sentence, term = np.divmod(once, max(self.size, 1))
        return Bags(term, np.bincount(sentence, minlength=len(parsed.lengths)), parsed.counts)


class Bags:
    """Documents as sentences as term numbers, in flat arrays."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, counts: np.ndarray):
        self.flat, self.lengths, self.counts = flat, lengths, counts
        self.begins = np.cumsum(lengths) - lengths
        self.filled = np.flatnonzero(counts)
        self.first = (np.cumsum(counts) - counts)[self.filled]

    def forward(self, w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
        """Score of the worst sentence of each document, and which it is; -30 and -1 for a document without sentences."""
        z = np.full(len(self.lengths), float(b))
        some = np.flatnonzero(self.lengths)
        if len(some):
            z[some] += np.add.reduceat(w[self.flat], self.begins[some]) / np.sqrt(self.lengths[some])
        top, which = np.full(len(self.counts), -30.0), np.full(len(self.counts), -1)
        if len(self.filled):
            top[self.filled] = np.maximum.reduceat(z, self.first)
            owner = np.repeat(np.arange(len(self.counts)), self.counts)
            hit = np.flatnonzero(z == top[owner])
            which[owner[hit][::-1]] = hit[::-1]
        return top, which

    def gradient(self, which: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the worst sentences, and the sum over each of ``g`` by the root of the sentence's length, in units."""
        there = which >= 0
        which, g = which[there], g[there]
        lengths = self.lengths[which]
        at = np.repeat(self.begins[which] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        return _sums(self.flat[at], np.repeat(_units(g / np.sqrt(np.maximum(lengths, 1))), lengths))


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys, sorted, and the sums of the values of each."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], *(np.add.reduceat(v[order], first) for v in values)


def _units(x: np.ndarray) -> np.ndarray:
    """Whole numbers of units, whose sums are the same in any order."""
    return np.rint(x / UNIT).astype(np.int64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Scorer:
    """Weights of terms (or the hashes of terms and their weights), intercept, cut of the score above which a
    document is reported, and the class prior."""

    weights: dict[str, float] | tuple[np.ndarray, np.ndarray]
    bias: float
    cut: float
    prior: float
    size: dict[str, int]

    def _tables(self) -> tuple[Vocabulary, np.ndarray, Words]:
        if "_made" not in self.__dict__:
            if isinstance(self.weights, dict):
                one = lambda *x: np.array([hashed(w) for w in x], np.int64)
                keys = np.array([int(paired(one(a), one(b))[0]) if b else hashed(a) for a, _, b in (t.partition(" ") for t in self.weights)], np.int64)
                values = np.array(list(self.weights.values()), float)
            else:
                keys, values = self.weights
            self.__dict__["_made"] = Vocabulary(keys), values, Words(lambda own: tuple(map(hashed, own)))
        return self.__dict__["_made"]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Per text between 0 and 1; 0 for a null text, and for a text without words."""
        out = np.zeros(len(texts))
        for i, j in _chunks(texts):
            out[i:j] = self.parsed_scores(Parsed.of(texts[i:j], self._tables()[2]))
        return out

    def parsed_scores(self, parsed: Parsed) -> np.ndarray:
        terms, values, _ = self._tables()
        top, which = terms.bags(parsed).forward(values, self.bias)
        return np.where(which >= 0, _sigmoid(top), 0.0)

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of texts that together have about ``CHUNK`` characters."""
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size < CHUNK):
            size += len(texts[end] or "")
            end += 1
        yield start, end
        start = end


def read(documents: DataFrame) -> DataFrame:
    """``doc_id, source, words, lengths``: the hashed words of each document and how many each sentence has, stored; null for a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Words(lambda own: tuple(map(hashed, own)))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in _chunks(texts):
                p = Parsed.of(texts[i:j], own)
                there = np.array([t is not None for t in texts[i:j]], bool)
                n = np.bincount(p.documents(), p.lengths, len(p.counts)).astype(np.int64)
                b = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), _lists(p.flat, n, pa.int64(), there), _lists(p.lengths, p.counts, pa.int32(), there)], names=["doc_id", "source", "words", "lengths"])

    return stored(documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, words array<bigint>, lengths array<int>"), "abuse-words")


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, counts: np.ndarray | None = None) -> float:
    """Share of positives among the unlabelled (with the count of each score): the least ratio of both tails above a score.

    Tails that hold 30 to 95 per cent of the positives count; a tail of unlabelled rows can't hold fewer than the prior's
    part of the positives'.
    """
    counts = np.ones(len(unlabelled)) if counts is None else counts
    at = np.quantile(positive, np.linspace(0.05, 0.7, 27))
    tails = [counts[unlabelled >= t].sum() / counts.sum() / (positive >= t).mean() for t in at]
    return float(np.clip(min(tails), *PRIORS))


#: What a row of terms is: confirmed positive, unlabelled, held out and harmless, held out and abusive.
POSITIVE, UNLABELLED, HARMLESS, ABUSIVE = range(4)
#: Numbers beside those of terms in the sums of a step.
SLOPES, SCORES, ROWS = -1, -2, -3
_TALLY = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("n", pa.int64())])


def _counted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of ``LEAST_DOCS`` positive and unlabelled rows at least: hash, positive rows, unlabelled rows; the most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []
        out = lambda k: pa.RecordBatch.from_arrays([pa.array(x) for x in k], names=["term", "inside", "outside"])
        for batch in batches:
            for b, p in Parsed.pieces(batch):
                h, owner = p.terms()
                owner = p.documents()[owner]
                order = np.argsort(h, kind="stable")
                h, owner = h[order], owner[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])[: len(h)]
                h, owner = h[new], owner[new]
                inside = b.column("part").to_numpy()[owner] == POSITIVE
                kept.append(_sums(h, inside.astype(np.int64), (~inside).astype(np.int64)))
                if sum(len(k[0]) for k in kept) > COUNTED:
                    kept = [_sums(*map(np.concatenate, zip(*kept)))]
                    if len(kept[0][0]) > COUNTED // 2:
                        yield out(kept.pop())
        if kept:
            yield out(_sums(*map(np.concatenate, zip(*kept))))

    found = rows.mapInArrow(run, "term bigint, inside bigint, outside bigint").groupBy("term").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    t = found.where(F.col("inside") + F.col("outside") >= LEAST_DOCS).toArrow()
    term, inside, outside = (t.column(c).to_numpy().astype(np.int64) for c in ("term", "inside", "outside"))
    order = np.lexsort([term, -(inside + outside)])
    return term[order], inside[order], outside[order]


class _Rows:
    """Rows of terms, ``part, slice, terms, lengths``: stored, or on the driver where they are few."""

    def __init__(self, rows: DataFrame, keys: np.ndarray, near: int):
        spark = rows.sparkSession
        shared = spark.sparkContext.broadcast(Vocabulary(keys))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b, p in Parsed.pieces(batch):
                    bags = shared.value.bags(p)
                    n = np.bincount(p.documents(), bags.lengths, len(p.counts)).astype(np.int64)
                    columns = [b.column("part"), pa.array(n), _lists(bags.flat, n, pa.int32()), _lists(bags.lengths, p.counts, pa.int32()), b.column("slice")]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "n", "terms", "lengths", "slice"])

        kind = "part int, n bigint, terms array<int>, lengths array<int>, slice int"
        path = f"{shared_folder(spark)}/abuse-terms-{uuid.uuid4().hex}"
        rows.mapInArrow(run, kind).write.partitionBy("slice").option("compression", "zstd").parquet(path)
        shared.destroy()
        self.far = spark.read.schema(kind).parquet(path)
        found = self.far.groupBy("part", "slice").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()
        self.size = {k: sum(r.rows for r in found if r.part == k) for k in range(4)}
        self.terms = [(r.slice, r.n) for r in found]
        self.kept: dict[tuple[int, ...], list[pa.RecordBatch]] = {}
        self.near = self.far.drop("n").toArrow().combine_chunks() if sum(n for _, n in self.terms) <= near else None

    def sums(self, f: Callable[[int, Bags], Iterator[tuple[np.ndarray, np.ndarray]]], slices: list[int], w: np.ndarray, b: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By part, different numbers and the whole sums of what ``f`` gives for the rows of these slices."""
        if self.near is not None:
            if (key := tuple(slices)) not in self.kept:
                self.kept[key] = self.near.filter(pa.array(np.isin(self.near.column("slice").to_numpy(), slices))).combine_chunks().to_batches()
            got = pa.Table.from_batches(list(_told(f, self.kept[key], w, b)), _TALLY)
        else:
            shared = self.far.sparkSession.sparkContext.broadcast((w, b))
            tasks = 1 + sum(n for s, n in self.terms if s in slices) // PIECE
            told = self.far.where(F.col("slice").isin(slices)).select("part", "terms", "lengths").coalesce(tasks).mapInArrow(lambda batches: _told(f, batches, *shared.value), "part int, at bigint, n bigint")
            got = (told if tasks <= FEW else told.groupBy("part", "at").agg(F.sum("n").alias("n"))).toArrow()
            shared.destroy()
        part, at, n = (got.column(c).to_numpy() for c in _TALLY.names)
        return {k: _sums(at[part == k], n[part == k]) for k in range(4)}


def _told(f: Callable, batches: Iterator[pa.RecordBatch], w: np.ndarray, b: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for own, p in Parsed.pieces(batch, "terms"):
            part = own.column("part").to_numpy()
            top, which = (bags := Bags(p.flat, p.lengths, p.counts)).forward(w, b)
            for k in np.unique(part):
                at, n = f(bags, top, which, part == k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at, pa.int64()), pa.array(n, pa.int64())], schema=_TALLY)


def _spread(bags: Bags, top: np.ndarray, which: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the scores, and how many rows each has."""
    return np.unique(np.floor(top[rows] / BIN).astype(np.int64), return_counts=True)


def _slopes(bags: Bags, top: np.ndarray, which: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the slopes by term, of all slopes and scores in units, and the count of rows."""
    s = _sigmoid(top[rows])
    g = s * (1 - s)
    at, sums = bags.gradient(which[rows], g)
    return np.append(at, [SLOPES, SCORES, ROWS]), np.append(sums, [_units(g).sum(), _units(s).sum(), len(s)])


def _slices(n: int) -> int:
    """Into how many slices the unlabelled rows are cut; it divides ``STEPS``."""
    return max(d for d in range(1, STEPS + 1) if STEPS % d == 0 and (d == 1 or n >= d * SLICE_ROWS))


def learn(rows: _Rows, inside: np.ndarray, outside: np.ndarray, slices: int, prior: float | None = None, steps: int = STEPS, rounds: int = ROUNDS) -> tuple[np.ndarray, float, float, int]:
    """Weights, intercept, class prior and rounds taken, by Adam on the non-negative risk with sigmoid loss.

    Each step takes all positives and one slice of the unlabelled rows, the slices in turn: every round sees all rows. That
    loss is bounded: a document confirmed by mistake, whose sentences all look harmless, hardly pulls. Without ``prior`` it
    is estimated by :func:`class_prior` from all rows before the first and after every round.

    The first worst sentences are those whose terms are most over-represented in the positives (log ratio of document
    counts, shrunk by ``SHRINK`` documents).
    """
    n_p, n_u = rows.size[POSITIVE], rows.size[UNLABELLED]
    everything = [-1, *range(slices)]
    start = SHARP * np.log((inside + SHRINK) / (outside * (n_p / n_u) + SHRINK))

    def estimate(w: np.ndarray, b: float) -> tuple[float, np.ndarray, np.ndarray]:
        got = rows.sums(_spread, everything, w, b)
        (p, n), (u, m) = got[POSITIVE], got[UNLABELLED]
        return given or class_prior(np.repeat(p, n) * BIN, u * BIN, m), u * BIN, m

    w, done, given = start.copy(), 0, prior
    prior, at, m = estimate(w, 0.0)
    b = -float(at[np.searchsorted(np.cumsum(m), (1 - prior) * m.sum())])
    size = len(w)
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps * rounds + 1):
        got = rows.sums(_slopes, [-1, (step - 1) % slices], w, b)
        grads, means = [], []
        for at, n in (got[POSITIVE], got[UNLABELLED]):
            own = dict(zip(at[at < 0].tolist(), n[at < 0].tolist()))
            count = max(own.get(ROWS, 0), 1)
            g = np.zeros(size + 1)
            g[at[at >= 0]] = n[at >= 0] * (UNIT / count)
            g[size] = own.get(SLOPES, 0) * UNIT / count
            grads.append(g)
            means.append(own.get(SCORES, 0) * UNIT / count)
        if means[1] - prior * means[0] >= 0:  # unlabelled as negative, less the positives among them
            grad = grads[1] - 2 * prior * grads[0]
        else:  # step back up while the corrected risk is below zero
            grad = prior * grads[0] - grads[1]
        grad[:size] += PENALTY * (w - start)
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-7)
        w -= move[:-1]
        b -= float(move[-1])
        if step % steps == 0:
            done += 1
            new = estimate(w, b)[0]
            stays = abs(new - prior) <= STAYS * prior and done > 1
            prior = new
            if stays:
                break
    return w, b, prior, done


def verdicts(labels: DataFrame) -> DataFrame:
    """``doc_id, mean``: the raters' mean judgement of each rated document; repeated rows of one rater count once each."""
    return labels.where("doc_id is not null and abusive is not null").groupBy("doc_id").agg(F.avg("abusive").alias("mean"))


def fit(documents: DataFrame, labels: DataFrame, positive_rows: int | None = None, unlabelled_rows: int | None = None, rated_rows: int | None = None, near: int = NEAR) -> Scorer:
    """The scorer, from all documents (texts, or as :func:`read`) and all ratings; three in ten rated documents only set the cut.

    A caller may bound the positives, unlabelled and held out rows: then those of the least hashes of doc_id count, the
    bound or all there are.

    Without a confirmed positive every score is 0.
    """
    docs = (documents if "words" in documents.columns else read(documents)).where("words is not null").select("doc_id", "words", "lengths")
    part = F.when(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(10)) < 3, F.lit(HARMLESS) + F.col("mean").cast("int")).when(F.col("mean") == 1, POSITIVE)
    judged = verdicts(labels).where("mean = 0 or mean = 1").withColumn("part", part).where("part is not null").select("doc_id", "part")
    rated = stored(met(docs, judged, "doc_id", limit=MET), "abuse-rated")
    total, n = docs.count(), {r.part: r["count"] for r in rated.groupBy("part").count().collect()}
    held = n.get(HARMLESS, 0) + n.get(ABUSIVE, 0)

    def take(df: DataFrame, bound: int | None, of: int, seed: int) -> DataFrame:
        return df if bound is None or of <= bound else by_hash(df, F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")), bound, of)

    if not n.get(POSITIVE):
        return Scorer({}, -30.0, 0.5, 0.0, {"positive": 0, "unlabelled": total if unlabelled_rows is None else min(total, unlabelled_rows), "rated": held if rated_rows is None else min(held, rated_rows)})
    slices = _slices(total if unlabelled_rows is None else min(total, unlabelled_rows))
    columns = "part", "slice", "words", "lengths"
    fitted = (
        take(rated.where(F.col("part") == POSITIVE), positive_rows, n[POSITIVE], 0).withColumn("slice", F.lit(-1)).select(*columns)
        .union(take(docs, unlabelled_rows, total, 1).select(F.lit(UNLABELLED).alias("part"), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(slices)).cast("int").alias("slice"), "words", "lengths"))
    )
    term, inside, outside = _counted(fitted.select("part", "words", "lengths"))
    rows = _Rows(fitted.union(take(rated.where(F.col("part") >= HARMLESS), rated_rows, held, 0).withColumn("slice", F.lit(-2)).select(*columns)), term, near)
    weights, bias, prior, rounds = learn(rows, inside, outside, slices)
    size = {"positive": rows.size[POSITIVE], "unlabelled": rows.size[UNLABELLED], "rated": rows.size.get(HARMLESS, 0) + rows.size.get(ABUSIVE, 0), "rounds": rounds}
    out = Scorer((term, weights), bias, 0.5, prior, size)
    got = rows.sums(_spread, [-2], weights, bias)
    if len(got[HARMLESS][0]) and len(got[ABUSIVE][0]):
        out.cut = best_cut(*got[HARMLESS], *got[ABUSIVE])
    return out


def best_cut(harmless: np.ndarray, harmless_rows: np.ndarray, abusive: np.ndarray, abusive_rows: np.ndarray) -> float:
    """The score from which on a document is reported, of the best F1 over all bins of scores before the sigmoid."""
    at, good, bad = _sums(np.concatenate([harmless, abusive]), np.concatenate([harmless_rows, 0 * abusive_rows]), np.concatenate([0 * harmless_rows, abusive_rows]))
    hit, all_ = np.cumsum(bad[::-1])[::-1], np.cumsum((good + bad)[::-1])[::-1]
    f1 = 2 * hit / (bad.sum() + all_)
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    p = _sigmoid(at * BIN)
    lower = p[best[0] - 1] if best[0] else 0.0
    return float((p[best[0]] + lower) / 2) if len(best) == 1 else float(np.median(p[best]))


def scored(documents: DataFrame, scorer: Scorer) -> DataFrame:
    """``doc_id, source, score, abusive`` for every document (texts, or as :func:`read`), whole texts; null and empty texts score 0.

    Repeated rows are scored each. Not shuffled.
    """
    shared = documents.sparkSession.sparkContext.broadcast(scorer)  # 16 bytes a term
    parsed = "words" in documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = ((b, own.parsed_scores(p)) for b, p in Parsed.pieces(batch)) if parsed else [(batch, own.scores(batch.column("text").to_pylist()))]
            for b, p in found:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(p), pa.array(p >= own.cut)], names=["doc_id", "source", "score", "abusive"])

    return documents.select("doc_id", "source", *(("words", "lengths") if parsed else ("text",))).mapInArrow(run, "doc_id bigint, source string, score double, abusive boolean")


def rates(documents: DataFrame, scorer: Scorer) -> DataFrame:
    """``source, documents, abusive, rate, mean_score`` per source (null is one of its own)."""
    n = F.count("*")
    hit = F.sum(F.col("abusive").cast("bigint"))
    return scored(documents, scorer).groupBy("source").agg(n.alias("documents"), hit.alias("abusive"), (hit / n).alias("rate"), F.avg("score").alias("mean_score"))
