"""Profiles of senders and pairs as three tables, folded with new messages without reading old ones again.

``totals``: one row per key; ``counters``: rows of a key with kind, value and count; ``samples``: the last ``RESERVOIR``
measured messages of a key. A fold adds up totals and counters and keeps the latest samples; all of it is pre-aggregated,
so a hot sender meets as one row per task and never as a group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import blocks, robust
from ..session import met
from .history import ORDER, RESERVOIR

#: Most values kept of a counter, those with the highest counts; parts in which the latest samples are first sought.
COUNTER_KEYS, SALT = 200, 16
SENDER, PAIR = ["sender"], ["sender", "recipient"]
KINDS = {
    "recipient": "recipient", "recipient_domain": "recipient_domain", "sender_domain": "domain", "reply_domain": "reply_domain", "display": "display", "auth": "auth_outcome",
    "word": "words", "url_domain": "url_domains", "file_type": "file_types",
}


@dataclass
class Profiles:
    """The tables of one kind of key (``SENDER`` or ``PAIR``)."""

    keys: list[str]
    totals: DataFrame
    counters: DataFrame
    samples: DataFrame

    def save(self, path: str) -> None:
        """Writes the tables under a new ``path``; the folder of the last fold stays readable."""
        for name in ("totals", "counters", "samples"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, keys: list[str]) -> Profiles:
        return cls(keys, *(spark.read.parquet(f"{path}/{n}") for n in ("totals", "counters", "samples")))


def auth_outcome(failed: Column) -> Column:
    """``fail`` if any of the three checks failed, else ``pass`` (no result counts as pass)."""
    return F.when(failed, "fail").otherwise("pass")


def capped(counters: DataFrame, keys: list[str], n: int = COUNTER_KEYS) -> DataFrame:
    """The ``n`` values of each key and kind with the highest counts (ties: the first in order)."""
    w = Window.partitionBy(*keys, "kind").orderBy(F.desc("n"), "value")
    return counters.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def latest_samples(rows: DataFrame, keys: list[str], n: int = RESERVOIR) -> DataFrame:
    """The last ``n`` rows of each key by time, uid and msg_id, first within ``SALT`` parts of a key and then of those."""
    late = [F.desc(c) for c in ORDER]
    part = rows.withColumn("_s", F.pmod(F.xxhash64("msg_id"), F.lit(SALT)))
    some = part.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(*late))).where(F.col("_k") <= n)
    return some.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*late))).where(F.col("_k") <= n).drop("_k", "_s")


def fold(old: Profiles | None, obs: DataFrame, keys: list[str] = SENDER, size: int = blocks.BLOCK_ROWS) -> Profiles:
    """``old`` with the learnable ``obs`` (``history.observations``), which must not have been folded before.

    Messages of a key are taken in order of time; an interval is that to the message before, and none where that lies
    in the future. Null keys read as ''.
    """
    rows = obs.where("learnable").withColumns({"auth_outcome": auth_outcome(F.col("auth_failed")), "recipient_domain": F.regexp_extract("recipient", "@([^@]+)$", 1)})
    rows, cut = blocks.blocked(rows, keys, "at", max(size, RESERVOIR))
    rows = blocks.running(rows, keys, ORDER, {"_n": F.lit(1)}, {"_last": F.col("at")}, cut)
    rows = blocks.running(rows, [*keys, "display"], ORDER, {"_shown": F.lit(1)}, {}, cut)
    if old is not None:
        was = old.totals.select(*keys, F.col("messages").alias("_om"), F.col("last_seen").alias("_ol"))
        seen = old.counters.where("kind = 'display'").select(*keys, F.col("value").alias("display"), F.col("n").alias("_os"))
        rows = met(met(rows, was, keys, "left"), seen, [*keys, "display"], "left")
        rows = rows.withColumns({"_n": F.col("_n") + F.coalesce("_om", F.lit(0)), "_last": F.greatest("_last", "_ol"), "_shown": F.col("_shown") + F.coalesce("_os", F.lit(0))}).drop("_om", "_ol", "_os")
    named = (F.col("display") != "") & (F.col("_n") > 0)
    gap = (F.unix_micros("at") - F.unix_micros("_last")) / 1e6
    sums = {"messages": F.lit(1), "file_messages": (F.col("n_files") > 0).cast("int"), "display_total": named.cast("int"), "display_ok": (named & (F.col("_shown") > 0)).cast("int")}
    totals = rows.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()], F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))
    values = [F.struct(F.lit(k).alias("kind"), (F.col(c) if c in ("words", "url_domains", "file_types") else F.array(c)).alias("v")) for k, c in KINDS.items()]
    counters = rows.select(*keys, F.explode(F.array(*values)).alias("x")).select(*keys, "x.kind", F.explode("x.v").alias("value")).where("value <> ''").groupBy(*keys, "kind", "value").agg(F.count("*").alias("n"))
    taken = rows.select(*keys, *ORDER, F.when(gap >= 0, gap).alias("interval"), "length", "n_urls", (F.hour("at") + F.minute("at") / 60.0).alias("hour"), F.weekday("at").alias("day"))
    if old is not None:
        both = old.totals.unionByName(totals)
        totals = both.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums], F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
        counters = old.counters.unionByName(counters).groupBy(*keys, "kind", "value").agg(F.sum("n").alias("n"))
        taken = old.samples.unionByName(taken)
    return Profiles(keys, totals, capped(counters, keys), latest_samples(taken, keys))


def derived(p: Profiles) -> DataFrame:
    """One row per key with what follows from the tables: rates, medians and spreads, usual hour and day, shares, most used display name."""
    angle = F.col("hour") * 3.141592653589793 / 12
    # bounded: at most RESERVOIR samples of a key meet here
    s = p.samples.groupBy(*p.keys).agg(
        *[F.collect_list(c).alias(f"_{c}") for c in ("interval", "length", "n_urls", "day")], F.sum(F.sin(angle)).alias("_y"), F.sum(F.cos(angle)).alias("_x")
    )
    for c in ("interval", "length", "n_urls"):
        s = s.withColumn(f"{c}_median", robust.median(F.col(f"_{c}")))
        s = s.withColumn(f"{c}_mad", robust.mad(F.col(f"_{c}"), F.col(f"{c}_median")))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: F.struct(F.size(F.filter("_day", lambda x: x == d)).alias("n"), (-d).alias("d"))))
    s = s.withColumn("_b", best).withColumn("usual_day", F.when(F.col("_b.n") / F.size("_day") >= 0.5, -F.col("_b.d"))).withColumn("usual_hour", robust.circular_hour(F.col("_y"), F.col("_x")))
    name = p.counters.where("kind = 'display'").groupBy(*p.keys).agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("display"))
    days = F.greatest((F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 86_400e6, F.lit(1 / 24))
    rows = met(met(p.totals, s.drop("_interval", "_length", "_n_urls", "_day", "_y", "_x", "_b"), p.keys, "left"), name, p.keys, "left")
    return rows.withColumns({"per_day": F.col("messages") / days, "file_share": F.col("file_messages") / F.col("messages"), "newness": 1 / (1 + F.col("messages") / (5.0 if p.keys == SENDER else 3.0))})


def lookup(messages: DataFrame, profiles: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``msg_id, profile_sender, messages, pair_messages``: the profile of a message's sender.

    Without one, that of the sender who used the display name most stands in, and the pair is sought under the profile's
    own address. ``profiles`` and ``pairs`` are tables as of :func:`derived`; a message without any has nulls.
    """
    own = messages.select("msg_id", F.lower(F.coalesce("from_addr", F.lit(""))).alias("sender"), F.lower(F.trim(F.coalesce("from_display", F.lit("")))).alias("display"), F.lower(F.coalesce(F.try_element_at("recipients", F.lit(1)), F.lit(""))).alias("recipient"))
    known = profiles.where("sender <> ''").select("sender", F.col("messages").alias("m"))
    shown = profiles.where("sender <> '' and display <> ''").groupBy("display").agg(F.max_by(F.struct(F.col("sender").alias("s"), F.col("messages").alias("m")), F.struct("messages", "sender")).alias("f"))
    rows = met(met(own, known, "sender", "left"), shown, "display", "left")
    rows = rows.select("msg_id", "recipient", F.when(F.col("m").isNotNull(), F.col("sender")).otherwise(F.col("f.s")).alias("profile_sender"), F.coalesce("m", "f.m").alias("messages"))
    if pairs is None:
        return rows.drop("recipient").withColumn("pair_messages", F.lit(None).cast("bigint"))
    p = pairs.where("recipient <> ''").select(F.col("sender").alias("profile_sender"), "recipient", F.col("messages").alias("pair_messages"))
    return met(rows, p, ["profile_sender", "recipient"], "left").select("msg_id", "profile_sender", "messages", "pair_messages")
