"""One row per entity with count, latest time and total for each of a list of event types.

The events are aggregated in a single pass by conditional count, sum and maximum expressions, one set per listed
type. The partial aggregate runs before the shuffle, so an entity that holds a third of all rows arrives as at most one
row per block of types and map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import met

EventType = tuple[str, str]
MAX_TYPES = 4096
BLOCK = 8


def bare_address(raw: Column) -> Column:
    """The address of a raw sender header in lower case; null where there is none.

    Read are ``Name <a@b>``, ``a@b (Name)``, ``mailto:a@b`` and the bare form; an address inside the quoted name is
    not the sender's. Null and empty headers give null.
    """
    angle = F.regexp_extract(raw, r"<\s*(?:mailto:)?([^<>\s@]+@[^<>\s@]+)\s*>\s*$", 1)
    rest = F.regexp_replace(raw, r'"[^"]*"|\([^()]*\)|^\s*(?i:mailto):', " ")
    plain = F.regexp_extract(rest, r"([^\s<>()\[\],;:@\"]+@[^\s<>()\[\],;:@\"]+)", 1)
    found = F.when(angle != "", angle).otherwise(plain)
    return F.lower(F.when(found != "", found))


def _name() -> Column:
    return F.upper(F.regexp_replace("verdict", r"\s+", ""))


def _codes(reasons: Column) -> Column:
    codes = F.array_distinct(F.filter(F.from_json(reasons, "array<string>"), lambda x: x.isNotNull() & (x != "")))
    return F.when(F.size(codes) > 0, codes).otherwise(F.array(F.lit("")))


def scored_events(emails: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per event: ``sender, received_at, mailbox, uid, score, verdict, reason``.

    Rows of equal (mailbox, uid) are one email, and so are repeated verdicts: the latest non-null one counts (ties: the
    greater verdict). Both sides shuffle once on that key and are joined where they are; it is unique per email, so no
    key is hot. Emails without address, time or verdict and verdicts without email give no event; a list of codes
    that is null, empty or unreadable gives one event with reason ''. Extra columns are ignored.
    """
    mail = (
        emails.select("mailbox", "uid", bare_address(F.col("sender")).alias("sender"), "received_at")
        .groupBy("mailbox", "uid")
        .agg(F.max("sender").alias("sender"), F.max("received_at").alias("received_at"))
        .where("sender is not null and received_at is not null")
    )
    name = _name()
    last = (
        verdicts.select("mailbox", "uid", "created_at", name.alias("verdict"), "reasons_json", "score")
        .where("verdict is not null and verdict <> ''")
        .groupBy("mailbox", "uid")
        .agg(F.max(F.struct("created_at", "verdict", "reasons_json", "score")).alias("v"))
    )
    codes = _codes(F.col("v.reasons_json"))
    return mail.join(last, ["mailbox", "uid"]).select(
        "sender", "received_at", "mailbox", "uid", F.col("v.score").alias("score"), F.col("v.verdict").alias("verdict"), F.explode(codes).alias("reason")
    )


def event_types(verdicts: DataFrame, limit: int = MAX_TYPES) -> list[EventType] | None:
    """The types that ``verdicts`` name, from one narrow scan of them, so that the events are built once.

    They become column names and go to every task; null where there are more than ``limit``.
    """
    rows = verdicts.where("verdict is not null and verdict <> ''").select(_name().alias("verdict"), F.explode(_codes(F.col("reasons_json"))).alias("reason"))
    found = rows.distinct().limit(limit + 1).collect()
    return None if len(found) > limit else sorted((r[0], r[1]) for r in found)


def feature_blocks(events: DataFrame, types: Sequence[EventType], width: int = BLOCK) -> DataFrame:
    """``sender, block, cells``: the cells of ``width`` neighbouring types, by conditional aggregates in one pass.

    Cell i of a block is ``n, total_score, last (received_at, mailbox, uid)`` of type ``block * width + i``. Narrow
    blocks keep the aggregation row small: one row for all types would be thousands of mostly empty fields, both in
    generated code and in the shuffle. Equal times go to the greater (mailbox, uid).
    """
    spark = events.sparkSession
    numbers = spark.createDataFrame([(v, r, k // width, k % width) for k, (v, r) in enumerate(types)], "verdict string, reason string, block int, slot int")
    slotted = met(events, numbers, ["verdict", "reason"], limit=MAX_TYPES).select("sender", "block", "slot", "score", F.struct("received_at", "mailbox", "uid").alias("at"))
    wide = []
    for i in range(width):
        here = F.col("slot") == i
        wide += [F.count(F.when(here, 1)).alias(f"n_{i}"), F.sum(F.when(here, F.col("score"))).alias(f"total_{i}"), F.max(F.when(here, F.col("at"))).alias(f"last_{i}")]
    one = [F.struct(F.col(f"n_{i}").alias("n"), F.col(f"total_{i}").alias("total_score"), F.col(f"last_{i}").alias("last")) for i in range(width)]
    return slotted.groupBy("sender", "block").agg(*wide).select("sender", "block", F.array(*one).alias("cells"))


def feature_table(events: DataFrame, types: Sequence[EventType], width: int = BLOCK) -> DataFrame:
    """One row per sender: for the k-th of ``types`` the columns ``n_k``, ``total_k``, ``last_k``.

    ``n_k`` is 0 and the others are null for a type the sender has no event of; events of types not listed are left
    out, a sender without a listed one too. No events: no rows. The rows that meet per sender are its blocks, at most
    one for every ``width`` types.
    """
    blocks = F.map_from_entries(F.collect_list(F.struct("block", "cells")))
    rows = feature_blocks(events, types, width).groupBy("sender").agg(blocks.alias("blocks"))
    out = []
    for k in range(len(types)):
        cell = F.try_element_at("blocks", F.lit(k // width))[k % width]
        out += [F.coalesce(cell["n"], F.lit(0)).alias(f"n_{k}"), cell["total_score"].alias(f"total_{k}"), cell["last"]["received_at"].alias(f"last_{k}")]
    return rows.select("sender", *out)


def found_cells(events: DataFrame, types: Sequence[EventType] | None, width: int = BLOCK) -> DataFrame:
    """The filled cells of the feature table as rows ``sender, verdict, reason, n, total_score, last_at, last_mailbox, last_uid``.

    Without a list (more types than can be columns) the type is a key of the aggregation and not a place in it.
    """
    if types is None:
        cells = events.groupBy("sender", "verdict", "reason").agg(F.count("*").alias("n"), F.sum("score").alias("total_score"), F.max(F.struct("received_at", "mailbox", "uid")).alias("last"))
        return cells.select("sender", "verdict", "reason", "n", "total_score", F.col("last.received_at").alias("last_at"), F.col("last.mailbox").alias("last_mailbox"), F.col("last.uid").alias("last_uid"))
    names = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("reason")) for v, r in types] or [F.struct(F.lit("").alias("verdict"), F.lit("").alias("reason"))])
    rows = feature_blocks(events, types, width).select("sender", "block", F.posexplode("cells").alias("i", "c")).where("c.n > 0")
    kind = F.get(names, F.col("block") * width + F.col("i"))
    last = F.col("c.last")
    return rows.select(
        "sender", kind["verdict"].alias("verdict"), kind["reason"].alias("reason"), F.col("c.n").alias("n"), F.col("c.total_score").alias("total_score"),
        last["received_at"].alias("last_at"), last["mailbox"].alias("last_mailbox"), last["uid"].alias("last_uid"),
    )
