"""Behaviour of senders and pairs against their own past, as point-in-time window aggregates.

Every feature of a message looks only at earlier rows of its sender (or sender and recipient), in the order of
(received_at, uid). Samples reach back ``RESERVOIR`` rows; a running sum has no limit. A sender with many rows is cut into
blocks of time with carried sums and an overlap of ``RESERVOIR`` rows, so that it is no single task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import blocks, robust
from ..functions.once import once
from ..functions.text import text_or_empty, token_set, STOPWORDS
from .headers import clean_domain

RESERVOIR = 500
FEATURES = (
    "sender_newness_score", "sender_frequency_anomaly", "sender_time_anomaly", "sender_domain_change_score", "sender_replyto_anomaly", "sender_url_behavior_anomaly",
    "sender_attachment_anomaly", "sender_authentication_anomaly", "recipient_relationship_newness", "recipient_relationship_anomaly", "display_name_history_anomaly", "communication_pattern_anomaly",
)


def observations(messages: DataFrame, received_at: Column | str = "ingested_at") -> DataFrame:
    """What history needs of each message, one narrow row; no body or header leaves the scan.

    ``learnable`` may be given as a column of ``messages`` (true where absent): only such rows enter the past of others.
    """
    at = F.col(received_at) if isinstance(received_at, str) else received_at
    own = messages.columns
    fails = F.coalesce(F.greatest(*[(F.col(f"{k}_result") == "fail") for k in ("spf", "dkim", "dmarc")]), F.lit(False))
    return messages.select(
        "msg_id", "uid", "mailbox", at.alias("at"), F.lower(text_or_empty(F.col("from_addr"))).alias("sender"), F.lower(text_or_empty(F.try_element_at("recipients", F.lit(1)))).alias("recipient"),
        clean_domain(F.col("from_addr")).alias("domain"), clean_domain(F.col("reply_to")).alias("reply_domain"), F.lower(F.trim(text_or_empty(F.col("from_display")))).alias("display"),
        F.length(text_or_empty(F.col("visible_text"))).cast("double").alias("length"), F.coalesce(F.size("urls"), F.lit(0)).cast("double").alias("n_urls"),
        F.coalesce(F.size("attachments"), F.lit(0)).alias("n_files"), fails.alias("auth_failed"), F.array_distinct(F.coalesce(F.transform("urls", lambda u: text_or_empty(u["domain"])), F.array().cast("array<string>"))).alias("url_domains"),
        F.array_distinct(F.coalesce(F.transform("attachments", lambda a: text_or_empty(a["content_type"])), F.array().cast("array<string>"))).alias("file_types"), token_set(F.col("subject"), STOPWORDS).alias("words"),
        (F.coalesce("learnable", F.lit(True)) if "learnable" in own else F.lit(True)).alias("learnable"),
    )


ORDER = ["at", "uid", "msg_id"]


def _recent(*keys: str):
    return Window.partitionBy(*keys, "_block").orderBy(*ORDER).rowsBetween(-RESERVOIR, -1)


def _if(condition: Column | None = None) -> Column:
    learn = F.col("learnable") if condition is None else F.col("learnable") & condition
    return F.when(learn, 1).otherwise(0)


def sender_state(obs: DataFrame, size: int = blocks.BLOCK_ROWS) -> DataFrame:
    """``obs`` with the sender's past at each message: counts, medians and spreads of recent samples, usual hour and day.

    A sender of more than ``size`` rows is cut into blocks of time (``functions.blocks``); the results are the same.
    """
    hour = F.hour("at") + F.minute("at") / 60.0
    angle = F.col("hour") * math.pi / 12
    learn = lambda c: F.when(F.col("learnable"), c)
    rows, cut = blocks.blocked(obs.withColumn("hour", hour).withColumn("day", F.weekday("at")), ["sender"], "at", max(size, RESERVOIR))
    rows = blocks.running(
        rows, ["sender"], ORDER,
        {"n": _if(), "n_reply": _if(F.col("reply_domain") != ""), "n_named": _if(F.col("display") != ""), "n_addressed": _if(F.col("recipient") != ""), "n_failed": _if(F.col("auth_failed")), "n_with_files": _if(F.col("n_files") > 0)},
        {"_lag": learn(F.col("at"))}, cut,
    )
    for name, key in (("n_domain", "domain"), ("n_display", "display"), ("n_recipient", "recipient"), ("n_reply_domain", "reply_domain")):
        rows = blocks.running(rows, ["sender", key], ORDER, {name: _if()}, {}, cut)
    rows = rows.withColumn("interval", (F.unix_micros("at") - F.unix_micros("_lag")) / 1e6).drop("_lag")
    rows = blocks.with_recent(rows, ["sender"], ORDER, RESERVOIR, cut)
    recent = _recent("sender")
    rows = rows.withColumns({
        "intervals": F.collect_list(learn(F.when(F.col("interval") >= 0, F.col("interval")))).over(recent), "lengths": F.collect_list(learn(F.col("length"))).over(recent),
        "url_counts": F.collect_list(learn(F.col("n_urls"))).over(recent), "days": F.collect_list(learn(F.col("day"))).over(recent),
        "usual_hour": robust.circular_hour(F.sum(learn(F.sin(angle))).over(recent), F.sum(learn(F.cos(angle))).over(recent)),
    })
    rows = rows.where("_own").drop("_own", "_block")
    samples = (("interval", "intervals"), ("length", "lengths"), ("url", "url_counts"))
    rows = once(rows, **{f"{name}_median": robust.median(F.col(x)) for name, x in samples})
    rows = once(rows, **{f"{name}_mad": robust.mad(F.col(x), F.col(f"{name}_median")) for name, x in samples})
    counts = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: F.struct(F.size(F.filter("days", lambda x: x == d)).alias("n"), (-d).alias("d")))
    best = F.array_max(counts)
    rows = once(rows, _best=best).withColumn("usual_day", F.when((F.size("days") > 0) & (F.col("_best.n") / F.size("days") >= 0.5), -F.col("_best.d")))
    return rows.withColumn("n_intervals", F.size("intervals")).drop("intervals", "lengths", "url_counts", "days", "_best")


def first_seen(obs: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``msg_id, items, known``: of a message's distinct items how many the same keys had in earlier messages.

    Items are compared with the time of their first learnable message per key, a pre-aggregated minimum, so no past
    vocabulary is ever collected.
    """
    order = F.struct("at", "uid", "msg_id")
    items = obs.select("msg_id", "learnable", *keys, order.alias("o"), F.explode(column).alias("item")).where("item <> ''")
    first = items.where("learnable").groupBy(*keys, "item").agg(F.min("o").alias("first"))
    return items.join(first.hint("merge"), [*keys, "item"], "left").groupBy("msg_id").agg(F.count("*").alias("items"), F.coalesce(F.sum(F.when(F.col("first") < F.col("o"), 1).otherwise(0)), F.lit(0)).alias("known"))


def vocabulary_size(obs: DataFrame, keys: list[str], size: int = blocks.BLOCK_ROWS) -> DataFrame:
    """``msg_id, vocabulary``: how many distinct subject words the keys had used before each message."""
    order = F.struct("at", "uid", "msg_id")
    first = obs.where("learnable").select(*keys, order.alias("o"), F.explode("words").alias("item")).groupBy(*keys, "item").agg(F.min("o").alias("o"))
    new = first.groupBy(*keys, "o").agg(F.count("*").alias("new"))
    rows, cut = blocks.blocked(obs.select("msg_id", "uid", "at", *keys, order.alias("o")), keys, "at", size)
    rows = rows.join(new.hint("merge"), [*keys, "o"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    return blocks.running(rows, keys, ORDER, {"vocabulary": F.col("new")}, {}, cut).select("msg_id", "vocabulary")


def relation_state(obs: DataFrame, size: int = blocks.BLOCK_ROWS) -> DataFrame:
    """``msg_id`` with the pair's past: messages, interval to the last one, median and spread of earlier intervals."""
    pair = ["sender", "recipient"]
    rows, cut = blocks.blocked(obs.select("msg_id", "uid", "at", *pair, "n_files", "learnable"), pair, "at", max(size, RESERVOIR))
    rows = blocks.running(rows, pair, ORDER, {"pair_n": _if(), "pair_files": _if(F.col("n_files") > 0)}, {"_lag": F.when(F.col("learnable"), F.col("at"))}, cut)
    rows = rows.withColumn("pair_interval", (F.unix_micros("at") - F.unix_micros("_lag")) / 1e6)
    rows = blocks.with_recent(rows, pair, ORDER, RESERVOIR, cut)
    rows = rows.withColumn("_i", F.collect_list(F.when(F.col("learnable") & (F.col("pair_interval") >= 0), F.col("pair_interval"))).over(_recent(*pair))).where("_own")
    rows = once(once(rows, pair_median=robust.median(F.col("_i"))), pair_mad=robust.mad(F.col("_i"), F.col("pair_median"))).withColumn("pair_intervals", F.size("_i"))
    return rows.select("msg_id", "pair_n", "pair_files", "pair_interval", "pair_median", "pair_mad", "pair_intervals")


def behaviour(obs: DataFrame, size: int = blocks.BLOCK_ROWS) -> DataFrame:
    """``msg_id`` with the twelve behaviour features, each in [0, 1], against the past of sender and pair.

    A sender without past has newness 1 and no anomaly. Messages of one time are ordered by uid and msg_id; msg_id must
    be unique. Null senders are one sender ''.
    """
    def part(keys, column, name):
        r = first_seen(obs, keys, column)
        return r.select("msg_id", F.col("items").alias(f"{name}_items"), F.col("known").alias(f"{name}_known"))

    rows = sender_state(obs, size).join(relation_state(obs, size).hint("merge"), "msg_id")
    pair = ["sender", "recipient"]
    for keys, column, name in ((["sender"], "url_domains", "u"), (["sender"], "file_types", "f"), (["sender"], "words", "w"), (pair, "url_domains", "pu"), (pair, "file_types", "pf"), (pair, "words", "pw")):
        rows = rows.join(part(keys, column, name).hint("merge"), "msg_id", "left")
    rows = rows.join(vocabulary_size(obs, ["sender"], size).hint("merge"), "msg_id").join(vocabulary_size(obs, pair, size).withColumnRenamed("vocabulary", "pair_vocabulary").hint("merge"), "msg_id")
    c = lambda n: F.coalesce(F.col(n), F.lit(0))
    n, known = F.col("n"), F.col("n") > 0
    gone = lambda name: F.when(c(f"{name}_items") > 0, 1 - c(f"{name}_known") / c(f"{name}_items")).otherwise(0.0)
    z = lambda x, m, s: robust.robust_z(F.col(x), F.col(m), F.col(s))
    divergence = lambda p, v: F.when(c(v) == 0, 0.0).when(F.size("words") == 0, 1.0).otherwise(1 - c(f"{p}_known") / (F.size("words") + c(v) - c(f"{p}_known")))
    share = F.when(n > 0, F.col("n_with_files") / n).otherwise(0.0)
    pair_share = F.when(F.col("pair_n") > 0, F.col("pair_files") / F.col("pair_n")).otherwise(0.0)
    burst = F.least(F.greatest(0.0 - z("interval", "interval_median", "interval_mad"), F.lit(0.0)) / robust.Z_THRESHOLD, F.lit(1.0))
    reply = F.when(known, robust.novelty(F.col("n_reply_domain"), F.col("n_reply"))).otherwise(0.0)
    scores = {
        "sender_newness_score": F.when(known, 1 / (1 + n / 5.0)).otherwise(1.0),
        "sender_frequency_anomaly": F.when((F.col("n_intervals") > 0) & (F.col("interval") >= 0), burst).otherwise(0.0),
        "sender_time_anomaly": F.when(known, F.greatest(robust.hour_anomaly(F.col("hour"), F.col("usual_hour")), robust.weekday_anomaly(F.col("day"), F.col("usual_day")))).otherwise(0.0),
        "sender_domain_change_score": F.when(known & (F.col("domain") != ""), robust.novelty(F.col("n_domain"), n)).otherwise(0.0),
        "sender_replyto_anomaly": F.when(F.col("reply_domain") == "", 0.0).otherwise(F.greatest(reply, F.when(F.col("reply_domain") != F.col("domain"), 0.6).otherwise(0.0))),
        "sender_url_behavior_anomaly": F.when(known, F.greatest(gone("u"), robust.score_of_z(z("n_urls", "url_median", "url_mad")))).otherwise(0.0),
        "sender_attachment_anomaly": F.when(known & (F.col("n_files") > 0), F.greatest(1 - share, gone("f"))).otherwise(0.0),
        "sender_authentication_anomaly": F.when(known & F.col("auth_failed"), 1 - F.col("n_failed") / n).otherwise(0.0),
        "recipient_relationship_newness": F.when(F.col("pair_n") > 0, 1 / (1 + F.col("pair_n") / 3.0)).otherwise(1.0),
        "recipient_relationship_anomaly": F.when(
            F.col("pair_n") > 0,
            F.least(F.greatest(
                F.when(F.col("pair_intervals") > 0, robust.score_of_z(z("pair_interval", "pair_median", "pair_mad"))).otherwise(0.0), divergence("pw", "pair_vocabulary"), gone("pu"),
                F.when(F.col("n_files") > 0, F.greatest(1 - pair_share, gone("pf"))).otherwise(0.0),
            ), F.lit(1.0)),
        ).otherwise(0.0),
        "display_name_history_anomaly": F.when(known & (F.col("display") != ""), robust.novelty(F.col("n_display"), F.col("n_named"))).otherwise(0.0),
        "communication_pattern_anomaly": F.when(
            known,
            F.least(F.greatest(
                divergence("w", "vocabulary"), robust.score_of_z(z("length", "length_median", "length_mad")),
                F.when(F.col("recipient") != "", robust.novelty(F.col("n_recipient"), F.col("n_addressed"))).otherwise(0.0),
            ), F.lit(1.0)),
        ).otherwise(0.0),
    }
    return rows.select("msg_id", "sender", *[v.cast("double").alias(k) for k, v in scores.items()])


def summary(features: DataFrame) -> DataFrame:
    """Adds the mean of the sender features, the greatest of all, and the state in words."""
    sender = [f for f in FEATURES if f.startswith(("sender_", "display_"))]
    top = F.greatest(*[F.col(f) for f in FEATURES])
    state = F.when(F.col("sender_newness_score") >= 1, "genuinely_unknown").when(top >= 0.75, "strongly_anomalous").when(top >= 0.4, "unusual").otherwise("normal")
    return features.withColumn("sender_anomaly_score", F.round(sum((F.col(f) for f in sender), F.lit(0.0)) / len(sender), 4)).withColumn("strongest", top).withColumn("state", state)
