"""Velocity: how many messages a sender, pair, recipient and link domain had in the hours up to each message.

Counts are pre-aggregated per key and hour, so a hot key is one row per hour, and the windows run over those rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import met

HOURS = (1, 24, 168, 720)
KEYS = {"sender": ["sender"], "pair": ["sender", "recipient"], "recipient": ["recipient"], "domain": ["domain"]}


def velocities(messages: DataFrame, time: str = "ingested_at") -> DataFrame:
    """``msg_id`` with 16 counts ``<key>_<hours>h``: messages of the key in that many hours, the current one included.

    Recipient and link domain are the first of a message; '' keys and null times have 0.
    """
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    rows = messages.select(
        "msg_id", F.floor(F.unix_micros(time) / 3_600_000_000).alias("hour"), text(F.col("from_addr")).alias("sender"), text(F.try_element_at("recipients", F.lit(1))).alias("recipient"),
        text(F.try_element_at("urls", F.lit(1))["domain"]).alias("domain"),
    )
    out = rows
    for name, keys in KEYS.items():
        filled = rows.where(" and ".join(f"{k} <> ''" for k in keys)).where("hour is not null")
        counts = filled.groupBy(*keys, "hour").agg(F.count("*").alias("n"))
        w = Window.partitionBy(*keys).orderBy("hour")
        made = counts.select(*keys, "hour", *[F.sum("n").over(w.rangeBetween(1 - h, 0)).alias(f"{name}_{h}h") for h in HOURS])
        out = met(out, made, [*keys, "hour"], "left")
    return out.select("msg_id", *[F.coalesce(f"{n}_{h}h", F.lit(0)).alias(f"{n}_{h}h") for n in KEYS for h in HOURS])
