"""Campaigns: messages tied together by shared links, files, subjects or close vectors."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.text import hash_embedding, text_or_empty, token_set

WEIGHTS = {"domain": 0.35, "file": 0.35, "subject": 0.2, "sender": 0.1, "words": 0.3, "letters": 0.15, "vector": 0.25}
LEAST_SIZE = 3


def signals(messages: DataFrame) -> DataFrame:
    """``msg_id, channel, value``: what a message shares with others, one row per distinct value.

    Channels: link domain, attachment name and type, subject without digits and reply marks, sender's domain.
    """
    subject = F.trim(F.regexp_replace(F.lower(text_or_empty(F.col("subject"))), r"^(?:\s*(?:re|aw|fwd?|wg)\s*:)+|\d+|\s+", " "))
    channels = F.array(
        F.struct(F.lit("domain").alias("channel"), F.coalesce(F.transform("urls", lambda u: F.lower(text_or_empty(u["domain"]))), F.array().cast("array<string>")).alias("v")),
        F.struct(F.lit("file").alias("channel"), F.coalesce(F.transform("attachments", lambda a: F.concat_ws("/", F.lower(a["filename"]), a["content_type"])), F.array().cast("array<string>")).alias("v")),
        F.struct(F.lit("subject").alias("channel"), F.array(subject).alias("v")),
        F.struct(F.lit("sender").alias("channel"), F.array(F.lower(F.regexp_extract(text_or_empty(F.col("from_addr")), r"@([^@>\s]+)", 1))).alias("v")),
    )
    return messages.select("msg_id", F.explode(channels).alias("c")).select("msg_id", "c.channel", F.explode("c.v").alias("value")).where("value <> ''").distinct()


def _least(items, seeds: int):
    """Per seed the least MD5 of the items with it: equal for two sets with the probability of their similarity."""

    def one(seed: int):
        return F.array_min(F.transform(items, lambda x: F.md5(F.concat(F.lit(f"{seed}:"), x))))

    return [one(k) for k in range(seeds)]


def text_signals(messages: DataFrame, bands: int = 4, rows: int = 2) -> DataFrame:
    """``msg_id, channel, value`` of texts that resemble each other: word sets of the body (``words``) and three-letter sets
    of the subject (``letters``) by minimum hashing in bands, and the signs of the body's hashed vector (``vector``)."""
    body = F.coalesce(F.nullif("visible_text", F.lit("")), "body_plain")
    subject = F.lower(F.regexp_replace(text_or_empty(F.col("subject")), r"\s+", " "))
    letters = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(subject) - 2, F.lit(1))), lambda i: F.substr(subject, i, F.lit(3))))
    out = []
    for name, items in (("words", token_set(body)), ("letters", F.when(F.length(subject) >= 3, letters))):
        own = messages.select("msg_id", items.alias("x")).where(F.size("x") > 0).select("msg_id", F.array(*_least(F.col("x"), bands * rows)).alias("h"))
        out.append(own.select("msg_id", F.lit(name).alias("channel"), F.posexplode(F.array(*[F.array_join(F.slice("h", b * rows + 1, rows), "") for b in range(bands)])).alias("b", "v")))
    signs = F.transform(hash_embedding(body), lambda x: F.when(x > 0, "+").when(x < 0, "-").otherwise("0"))
    own = messages.where(F.length(body) > 0).select("msg_id", signs.alias("h"))
    width = 768 // bands
    out.append(own.select("msg_id", F.lit("vector").alias("channel"), F.posexplode(F.array(*[F.array_join(F.slice("h", b * width + 1, width), "") for b in range(bands)])).alias("b", "v")))
    whole = out[0].unionByName(out[1]).unionByName(out[2])
    return whole.select("msg_id", "channel", F.concat(F.col("b").cast("string"), F.lit(":"), F.md5("v")).alias("value"))


def campaign_table(rows: DataFrame, least: int = LEAST_SIZE) -> DataFrame:
    """``channel, value, messages, weight, promoted``: every shared value and whether enough messages have it.

    Counts are pre-aggregated; members stay in ``signals``, so no group is ever gathered.
    """
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("channel"))
    return rows.groupBy("channel", "value").agg(F.count("*").alias("messages")).where("messages > 1").select("channel", "value", "messages", weight.alias("weight"), (F.col("messages") >= least).alias("promoted"))


def membership(rows: DataFrame, table: DataFrame, least_channels: int = 2) -> DataFrame:
    """``msg_id, channels, score``: messages in promoted groups of at least ``least_channels`` channels."""
    hit = rows.join(table.where("promoted").select("channel", "value", "weight"), ["channel", "value"])
    best = hit.groupBy("msg_id", "channel").agg(F.max("weight").alias("weight"))
    return best.groupBy("msg_id").agg(F.count("*").alias("channels"), F.round(F.sum("weight"), 6).alias("score")).where(F.col("channels") >= least_channels)


def close_vectors(vectors: DataFrame, threshold: float = 0.9, every: int = 50, block: int = 2_000) -> DataFrame:
    """``query_id, vec_id, similarity``: rows whose id is divisible by ``every`` as queries, against all rows, exact.

    The queries are cut by hash into blocks of about ``block`` rows; each meets all rows as one broadcast matrix of bounded
    size, in Arrow batches. Null and zero vectors, and those of another length, are close to nothing.
    """
    q = vectors.where((F.col("vec_id") % every == 0) & F.col("embedding").isNotNull()).select("vec_id", "embedding")
    blocks = q.count() // block + 1

    def near(number: int) -> DataFrame:
        own = q.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).collect()
        length = max((len(r.embedding) for r in own), default=0)
        kept = [(r.vec_id, np.array(r.embedding, float)) for r in own if len(r.embedding) == length and None not in r.embedding and any(r.embedding)]
        ids, matrix = np.array([i for i, _ in kept], np.int64), np.array([v / np.linalg.norm(v) for _, v in kept]).reshape(len(kept), length)

        def run(batches):
            for b in batches:
                rows = [(i, v) for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist()) if v is not None and len(v) == length and None not in v and any(v)]
                if not rows or not len(ids):
                    continue
                x = np.array([v for _, v in rows], float)
                cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ matrix.T
                at, to = np.nonzero(np.round(cos, 6) >= threshold)
                own_ids = np.array([i for i, _ in rows], np.int64)
                keep = own_ids[at] != ids[to]
                yield pa.RecordBatch.from_arrays([pa.array(ids[to][keep]), pa.array(own_ids[at][keep]), pa.array(np.round(cos[at, to][keep], 6))], names=["query_id", "vec_id", "similarity"])

        return vectors.select("vec_id", "embedding").mapInArrow(run, "query_id bigint, vec_id bigint, similarity double")

    return reduce(DataFrame.unionByName, [near(i) for i in range(blocks)])
