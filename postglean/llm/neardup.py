"""Near-duplicate messages: SuperMinHash signatures, banding, exact verification, grouping by union of links.

Words are drawn from per-word random permutations of the signature's places: step j of a word gives a value between j
and j + 1 to the j-th place of its permutation, and the signature keeps the least value per place. Values of later steps
can't beat earlier ones, so a text stops as soon as all its places are filled below the next step.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage

WORD = re.compile(r"[^\W_]+")
#: Least distinct words of a message, least share of common words.
LEAST_WORDS, THRESHOLD = 25, 0.7
#: At 0.7 a pair meets in one of 96 bands of 7 places with probability 0.9997; unrelated texts (0.2) with 0.0012.
BANDS, ROWS = 96, 7
#: Bytes of the sketch that candidates are compared by first, and how many must agree (0.7 fails with 5e-6).
SKETCH, SKETCH_AGREE = 64, 29
CACHED_WORDS = 40_000
#: Rows of a bucket (or class) that meet in one task; larger ones are cut into blocks of about so many.
BLOCK = 1_000
#: Word sets a task remembers, to hash the bands of a copy only once.
SEEN_SETS = 200_000
_GOLDEN, _A, _B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class SuperMinHash:
    """Signatures of ``size`` places. Permutations of words are kept between batches, ``cached`` at most."""

    def __init__(self, size: int = BANDS * ROWS, cached: int = CACHED_WORDS):
        self.size, self.cached = size, cached
        self.index: dict[str, int] = {}
        self.hashes = np.empty(cached, np.uint64)
        self.place = np.empty((cached, size), np.uint16)
        self.value = np.empty((cached, size), np.uint32)

    def _permute(self, hashes: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
        n, m = len(hashes), self.size
        place[:] = np.arange(m, dtype=np.uint16)
        row = np.arange(n)
        with np.errstate(over="ignore"):
            for j in range(m):
                bits = _mix(hashes + np.uint64(j + 1) * _GOLDEN)
                k = j + (((bits & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
                place[:, j], place[row, k] = place[row, k], place[:, j].copy()
                value[:, j] = (np.uint64(j) << np.uint64(22)) + (bits >> np.uint64(42))

    def rows(self, words: list[list[str]]) -> np.ndarray:
        """Places of the words in the kept arrays; together they may have no more than ``cached`` different words."""
        new = sorted({w for s in words for w in s if w not in self.index})
        if len(self.index) + len(new) > self.cached:
            self.index.clear()
            new = sorted({w for s in words for w in s})
        if new:
            import xxhash

            a, b = len(self.index), len(self.index) + len(new)
            self.hashes[a:b] = np.array([xxhash.xxh64_intdigest(w.encode()) for w in new], np.uint64)
            self._permute(self.hashes[a:b], self.place[a:b], self.value[a:b])
            self.index.update(zip(new, range(a, b)))
        return np.fromiter((self.index[w] for s in words for w in s), np.int64)

    def signatures(self, words: list[set[str]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Signature per text (none may be empty), and the sorted hashes of its words.

        A text of more words than are kept is taken in pieces: the least of the pieces' signatures is its own.
        """
        sign, hashes = np.full((len(words), self.size), 0xFFFFFFFF, np.uint32), [[] for _ in words]
        batch: list[tuple[int, list[str]]] = []
        held = 0

        def flush() -> None:
            if batch:
                made, row = self._signatures([w for _, w in batch])
                at = 0
                for (i, w), x in zip(batch, made):
                    np.minimum(sign[i], x, out=sign[i])
                    hashes[i].append(self.hashes[row[at : at + len(w)]])
                    at += len(w)

        for i, own in enumerate(words):
            own = list(own)
            for start in range(0, len(own), self.cached):
                piece = own[start : start + self.cached]
                if held + len(piece) > self.cached:
                    flush()
                    batch, held = [], 0
                batch.append((i, piece))
                held += len(piece)
        flush()
        return sign, [np.sort(np.concatenate(h)) for h in hashes]

    def _signatures(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        m, n = self.size, len(words)
        row = self.rows(words)
        text = np.repeat(np.arange(n), [len(s) for s in words])
        least = np.full(n * m, 0xFFFFFFFF, np.uint32)
        open_rows, open_text = row, text
        for j in range(m):
            np.minimum.at(least, open_text * m + self.place[open_rows, j], self.value[open_rows, j])
            if j % 4 == 3 or j == m - 1:
                done = (least.reshape(n, m) >> np.uint32(22)).max(axis=1) <= j
                keep = ~done[open_text]
                open_rows, open_text = open_rows[keep], open_text[keep]
                if not len(open_rows):
                    break
        return least.reshape(n, m), row


def words_of(*texts: str | None) -> set[str]:
    """The different words: runs of letters and digits in lower case; null counts as empty."""
    return set(WORD.findall("\n".join(t or "" for t in texts).lower()))


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band, made with the band's number: different bands, and different places in one, don't meet."""
    with np.errstate(over="ignore"):
        out = np.tile(_mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN), (len(signatures), 1))
        parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows).astype(np.uint64)
        for r in range(rows):
            out = _mix(out * _GOLDEN + parts[:, :, r])
    return out.view(np.int64)


def fingerprints(messages: DataFrame, least_words: int = LEAST_WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``msg_id, same, words, bands, sketch`` of messages with enough words; ``same`` is a digest of the word set.

    A copy that its task has met before has no ``words``, ``bands`` and ``sketch``: its first carrier stands for it.
    """
    size = max(bands * rows, SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = SuperMinHash(size)
        seen: set[frozenset[str] | bytes] = set()
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                b = whole.slice(start, 500)
                ids, same, sets, copies = [], [], [], ([], [])
                for i, s, t in zip(*(b.column(c).to_pylist() for c in ("msg_id", "subject", "body_plain"))):
                    own = words_of(s, t)
                    if len(own) < max(1, least_words):
                        continue
                    digest = hashlib.blake2b("\n".join(sorted(own)).encode(), digest_size=16).digest()
                    if digest in seen:
                        copies[0].append(i), copies[1].append(digest)
                        continue
                    if len(seen) >= SEEN_SETS:
                        seen.clear()
                    seen.add(digest)
                    ids.append(i), same.append(digest), sets.append(own)
                names = ["msg_id", "same", "words", "bands", "sketch"]
                types = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
                if copies[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(copies[0], types[0]), pa.array(copies[1], types[1]), *(pa.nulls(len(copies[0]), t) for t in types[2:])], names=names)
                if not sets:
                    continue
                sign, parts = maker.signatures(sets)
                ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                sketch = (_mix(sign[:, :SKETCH].astype(np.uint64) + _GOLDEN) & np.uint64(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, types[0]),
                        pa.array(same, types[1]),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts).view(np.int64))),
                        pa.ListArray.from_arrays(np.arange(0, (len(ids) + 1) * bands, bands, dtype=np.int32), pa.array(band_hashes(sign, bands, rows).ravel())),
                        pa.array([x.tobytes() for x in sketch], types[4]),
                    ],
                    names=names,
                )

    return messages.select("msg_id", "subject", "body_plain").where("msg_id is not null").mapInArrow(run, "msg_id bigint, same binary, words array<bigint>, bands array<bigint>, sketch binary")


def _met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by shuffle and sort, whatever the optimizer takes the sizes for; tables here grow with the messages."""
    return left.join(right.hint("merge"), on, how)


def _parts(n: str, block: int):
    return F.ceil(F.col(n) / block).cast("int")


def pairs_within(rows: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """``key, a, b`` with a < b: all pairs of the ``id`` that share ``key``; ``n`` is the number of rows of the key.

    A key of more than ``block`` rows is cut into parts by the hash of the id, and each part meets all of its key in a
    task of its own, so no task holds more than ``block`` rows against the rest; nothing is capped.
    """
    parted = rows.where("n > 1").select(key, "id", F.pmod(F.xxhash64("id"), _parts("n", block)).cast("int").alias("part"))
    left = parted.select(key, F.col("part").alias("with"), F.col("id").alias("a"), F.col("part").alias("p"))
    right = parted.select(key, F.explode(F.sequence(F.lit(0), "part")).alias("with"), F.col("id").alias("b"), F.col("part").alias("q"))
    met = _met(left, right, [key, "with"]).where("p < q and a <> b or p = q and a < b")
    return met.select(key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def buckets(prints: DataFrame) -> DataFrame:
    """``hash, id, n``: rows of the bands that two or more carriers of different word sets share, ``n`` of them.

    One shuffle on the hash serves all. Carriers of one word set in several tasks meet in every band and leave the
    least; they are told by 32 bits of their digest, which loses a pair with probability 2 ** -32.
    """
    tag = F.hash("same")
    banded = prints.where("bands is not null").select(F.explode("bands").alias("hash"), tag.alias("tag"), F.col("msg_id").alias("id"))
    single = banded.repartition("hash").groupBy("hash", "tag").agg(F.min("id").alias("id"))
    counted = single.select("hash", "id", F.count("*").over(Window.partitionBy("hash")).cast("int").alias("n"))
    return cut_lineage(counted.where("n > 1"))


def verified(pairs: DataFrame, prints: DataFrame, threshold: float) -> DataFrame:
    """``a, b, similarity`` of candidate ``pairs`` whose whole word sets share ``threshold`` or more, sketches first."""

    def add(df: DataFrame, side: str, column: str) -> DataFrame:
        return _met(df, prints.where(F.col(column).isNotNull()).select(F.col("msg_id").alias(side), F.col(column).alias(f"{column}_{side}")), side)

    close = add(add(pairs, "a", "sketch"), "b", "sketch").where(_agreeing("sketch_a", "sketch_b") >= SKETCH_AGREE).select("a", "b")
    both = F.size(F.array_intersect("words_a", "words_b"))
    share = both / (F.size("words_a") + F.size("words_b") - both)
    return add(add(close, "a", "words"), "b", "words").select("a", "b", share.alias("similarity")).where(F.col("similarity") >= threshold)


def members_of(prints: DataFrame, block: int = BLOCK, few: int = 10_000) -> DataFrame:
    """``msg_id, class, n``: classes of equal word sets, named by the least msg_id, with their size.

    Sizes are counted before the shuffle. Rows of classes above ``100 * block`` are named by a broadcast table where
    there are at most ``few`` such classes (counted), so that they need not come together; beyond that they shuffle.
    """
    rows = prints.select("msg_id", "same").distinct()
    best = cut_lineage(rows.groupBy("same").agg(F.min("msg_id").alias("class"), F.count("*").alias("n")))
    hot = best.where(F.col("n") > 100 * block)
    found = hot.limit(few + 1).count()
    if not found or found > few:
        return cut_lineage(_met(rows, best, "same").select("msg_id", "class", "n"))
    named = rows.join(F.broadcast(hot), "same").select("msg_id", "class", "n")
    rest = _met(rows.join(F.broadcast(hot.select("same")), "same", "left_anti"), best, "same").select("msg_id", "class", "n")
    return cut_lineage(named.unionByName(rest))


def _agreeing(a: str, b: str):
    """Number of equal bytes of two sketches, on hex texts of built-in expressions."""
    places = F.sequence(F.lit(1), F.lit(SKETCH))
    return F.size(F.filter(places, lambda i: F.substr(F.col(a), i, F.lit(1)) == F.substr(F.col(b), i, F.lit(1))))


def _of_classes(links: DataFrame, members: DataFrame) -> DataFrame:
    """``a, b`` as classes, from links between carriers."""
    name = members.select("msg_id", "class")
    a = _met(links, name.select(F.col("msg_id").alias("a"), F.col("class").alias("x")), "a")
    return _met(a, name.select(F.col("msg_id").alias("b"), F.col("class").alias("y")), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_pairs(messages: DataFrame, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS, block: int = BLOCK) -> DataFrame:
    """``msg_id_a, msg_id_b`` (smaller first): messages whose word sets share ``threshold`` or more.

    Null texts count as empty; messages with fewer than ``least_words`` words, and null ids, are in no pair. Every
    stored message is a case, so copies come out as pairs with each other and with all partners of their class. Rows
    of one msg_id are one message, which resembles another if one of its texts does.
    """
    prints = cut_lineage(fingerprints(messages, least_words))
    members = members_of(prints, block)
    links = _of_classes(verified(pairs_within(buckets(prints), "hash", block).select("a", "b").distinct(), prints, threshold), members)
    within = pairs_within(members.select("class", F.col("msg_id").alias("id"), "n"), "class", block).select("a", "b")
    parts = members.select("class", _parts("n", block).alias("parts")).distinct()
    spread = members.select("class", F.pmod(F.xxhash64("msg_id"), _parts("n", block)).cast("int").alias("part"), "msg_id")

    def expand(df: DataFrame, side: str) -> DataFrame:  # each part of a class's members in a task of its own
        cut = _met(df, parts.withColumnRenamed("class", side), side).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return _met(cut, spread.withColumnRenamed("class", side), [side, "part"]).drop(side, "part").withColumnRenamed("msg_id", side)

    across = expand(expand(links, "a"), "b").select("a", "b")
    rows = across.unionByName(within).where("a <> b")
    return rows.select(F.least("a", "b").alias("msg_id_a"), F.greatest("a", "b").alias("msg_id_b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``id, root``: union-find over links ``a, b`` by alternating large and small stars until nothing changes.

    Each round is two aggregations on node ids; rows stay links, so no component is ever gathered in one place.
    """
    edges = cut_lineage(links.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = _met(both.where("u > v"), least, "v").select("u", F.col("m").alias("v")).where("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _met(large, root, "u")
        edges = cut_lineage(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
        before = now


def joining_links(rows: DataFrame, prints: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``a, b``: verified links that connect the same carriers as all of them would.

    Buckets up to ``block`` rows list their pairs. A larger one links its rows to its least id; after the components of
    these links only rows outside the bucket's greatest component meet the rest of it, so a template with small edits in
    a third of all messages costs one link per message, and no link between components is lost.
    """
    hot = rows.where(F.col("n") > block)
    pairs = pairs_within(rows.where(F.col("n") <= block), "hash", block).select("a", "b")
    if hot.isEmpty():
        return verified(pairs.distinct(), prints, threshold).select("a", "b")
    star = _met(hot, hot.groupBy("hash").agg(F.min("id").alias("a")), "hash").where("id <> a").select("a", F.col("id").alias("b"))
    first = cut_lineage(verified(pairs.unionByName(star).distinct(), prints, threshold).select("a", "b"))
    placed = cut_lineage(_met(hot, components(first), "id", "left").select("hash", "id", F.coalesce("root", "id").alias("root")))
    size = placed.groupBy("hash", "root").agg(F.count("*").alias("k"))
    great = size.groupBy("hash").agg(F.max(F.struct("k", "root"))["root"].alias("great"))
    out = _met(placed, great, "hash").where("root <> great").select("hash", F.col("id").alias("x"), F.col("root").alias("own"))
    more = _met(placed, out, "hash").where("root <> own").select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()
    return first.unionByName(verified(more, prints, threshold).select("a", "b"))


def groups(messages: DataFrame, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS, block: int = BLOCK) -> DataFrame:
    """``msg_id, class_id, group_id``: one row per message with enough words.

    ``class_id`` (the least msg_id) names messages of equal word sets, ``group_id`` (the least class) those connected by
    similarity of ``threshold`` or more.
    """
    prints = cut_lineage(fingerprints(messages, least_words))
    members = members_of(prints, block)
    links = _of_classes(joining_links(buckets(prints), prints, threshold, block), members)
    rows = _met(members, components(links).withColumnRenamed("id", "class"), "class", "left")
    return rows.select("msg_id", F.col("class").alias("class_id"), F.coalesce("root", "class").alias("group_id"))
