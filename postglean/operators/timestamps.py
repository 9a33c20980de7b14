"""Time texts of mixed formats, precisions and zones as one UTC instant, or as undetermined.

Every text is parsed by built-in expressions under each reading that its shape allows. Where more than one reading is a
valid time (dates with slashes), an expectation-maximisation over the mixture of readings of its source decides: the
values of a source pool their evidence, and what stays undecided is marked, never guessed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import met, stored

# Month names, zone names of mail headers with their offsets in minutes.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ZONES = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "jst": 540, "aest": 600, "aedt": 660, "brt": -180,
}
CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([AaPp][Mm])?"
ZONE = r"\s*(?:([+-]\d{2}:?\d{2}|[A-Za-z]{1,5})?(?:\s*\([^()]*\))?)"
WEEKDAY = r"(?:[A-Za-z]{3,9},?\s+)?"
# Shapes: kind, pattern, and the places in it of year, month, day, hour, minute, second, fraction, am/pm and zone.
SHAPES = (
    ("time", rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})[T ]\s*{CLOCK}{ZONE}$", "123456789"),
    ("time", rf"^{WEEKDAY}(\d{{1,2}})[ -]([A-Za-z]{{3,9}})[ -](\d{{4}}|\d{{2}}),?\s+{CLOCK}{ZONE}$", "321456789"),
    ("time", rf"^{WEEKDAY}([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}}),\s*(\d{{4}}|\d{{2}}),?\s+{CLOCK}{ZONE}$", "312456789"),
    ("time", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}}),?\s+{CLOCK}{ZONE}$", "321456789"),
    ("time", rf"^[A-Za-z]{{3}}\s+([A-Za-z]{{3}})\s+(\d{{1,2}})\s+{CLOCK}\s+(?:([A-Za-z]{{1,5}}|[+-]\d{{4}})\s+)?(\d{{4}})$", "912345678"),
    ("time", r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})?()()(Z|[+-]\d{2}:?\d{2})?$", "123456789"),
    ("slash", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}}),?\s+{CLOCK}{ZONE}$", "321456789"),
    ("epoch", r"^(\d{9,10}|\d{12,13}|\d{15,16})$", "1"),
)
#: Span within which the times of one message are expected (days), and the likelihood of a reading outside it.
NEAR_DAYS, FAR_LIKELIHOOD = 4.0, 0.02
#: Weight of a relay's declared date order, in values; posterior needed to accept a reading; iterations.
PRIOR_WEIGHT, ACCEPT, ROUNDS = 20.0, 0.9, 25
#: Tables of relays and sources up to so many rows are sent to every task; parts of a hot source in the join beyond that.
SENT_ROWS, SALT = 100_000, 16


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each computed once per row: a generator keeps the optimizer from repeating them inline."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _fields(text: Column) -> Column:
    """Array: kind, year, month, day, hour, minute, second, fraction, am/pm, zone as texts; null where no shape fits.

    A date with slashes has its second number as month and its first as day.
    """
    out = None
    for kind, pattern, places in SHAPES:
        made = F.regexp_replace(text, pattern, "\x01".join([kind, *(f"${i}" for i in places)]))
        out = F.when(text.rlike(pattern), made) if out is None else out.when(text.rlike(pattern), made)
    return F.split(out, "\x01")


def _whole(x: Column) -> Column:
    return F.when(x.rlike(r"^\d{1,18}$"), x.cast("bigint"))


def _local(f: Column, month: Column, day: Column) -> Column:
    """Local time as microseconds since 1970; null where it is no valid time."""
    named = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(MONTHS, 1) for x in (n, i)]), F.lower(F.substring(month, 1, 3)))
    m, d, y = F.coalesce(_whole(month), named), _whole(day), _whole(f[1])
    year = F.when(F.length(f[1]) == 2, y + 2000).otherwise(y)
    hour, half = _whole(f[4]), F.lower(f[8])
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
    minute, second = _whole(f[5]), F.coalesce(_whole(f[6]), F.lit(0))
    ok = (year >= 1900) & m.between(1, 12) & (hour <= 23) & (minute <= 59) & (second <= 59)
    date = F.try_to_date(F.when(ok, F.format_string("%04d-%02d-%02d", year, m, d)), "yyyy-MM-dd")
    micros = F.when(f[7] == "", 0).otherwise(F.rpad(F.substring(f[7], 1, 6), 6, "0").cast("bigint"))
    return ((F.unix_date(date).cast("bigint") * 24 + hour) * 60 + minute) * 60_000_000 + second * 1_000_000 + micros


def _offset(zone: Column) -> Column:
    """Offset in minutes of a written zone; null for none; -9999 for one that is not known."""
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    number = sign * (_whole(F.substring(digits, 1, 2)) * 60 + _whole(F.substring(digits, 3, 2)))
    named = F.element_at(F.create_map(*[F.lit(x) for n, o in ZONES.items() for x in (n, o)]), F.lower(zone))
    return F.when(zone == "", None).when(zone.rlike(r"^[+-]"), F.when(F.abs(number) <= 14 * 60, number).otherwise(-9999)).otherwise(F.coalesce(named, F.lit(-9999)))


def _utc(local: Column, offset: Column, tz: Column) -> Column:
    """UTC microseconds; null for a local time that its zone skips or repeats, or whose zone is not known."""
    wall = F.timestamp_micros(local)
    there = F.to_utc_timestamp(wall, tz)
    back = lambda minutes: F.from_utc_timestamp(F.timestamp_micros(F.unix_micros(there) + minutes * 60_000_000), tz) == wall
    once = back(0) & ~reduce(lambda a, b: a | b, [back(m) for m in (-60, -30, 30, 60)])
    return F.when(offset.isNotNull(), F.when(offset != -9999, local - offset * 60_000_000)).when(tz.isNotNull() & once, F.unix_micros(there))


def parse_times(df: DataFrame, text: str, tz: str) -> DataFrame:
    """Adds ``readings`` (array of ``order, at`` in UTC microseconds, only valid ones), ``slash``, ``precision`` (unit in microseconds).

    ``tz`` is the column with the zone of entries without one; null leaves those undetermined. Null, empty and
    senseless texts have no reading. ``df`` must not have columns of these names or starting with ``_``.
    """
    f, zone, size = F.col("_f"), F.col(tz), F.length(F.col("_f")[1])
    whole = _whole(f[1])
    df = _once(df, _f=_fields(F.trim(F.regexp_replace(F.col(text), r"\s+", " "))))
    df = _once(
        df,
        _epoch=F.when(f[0] == "epoch", F.when(size <= 10, whole * 1_000_000).when(size <= 13, whole * 1000).otherwise(whole)),
        _a=F.when(f[0] != "epoch", _local(f, f[2], f[3])),
        _b=F.when(f[0] == "slash", _local(f, f[3], f[2])),
        _o=F.when(f[0] != "epoch", _offset(f[9])),
        slash=F.coalesce(f[0] == "slash", F.lit(False)),
        precision=F.when(f[0] == "epoch", F.when(size <= 10, 1_000_000).when(size <= 13, 1000).otherwise(1))
        .when(F.length(f[7]) > 3, 1)
        .when(F.length(f[7]) > 0, 1000)
        .when(f[6] != "", 1_000_000)
        .when(f.isNotNull(), 60_000_000)
        .cast("bigint"),
    )
    first = F.coalesce("_epoch", _utc(F.col("_a"), F.col("_o"), zone))
    one = lambda order, at: F.struct(F.lit(order).alias("order"), at.alias("at"))
    both = F.array(one("dmy", first), one("mdy", _utc(F.col("_b"), F.col("_o"), zone)))
    df = _once(df, _r=F.when(F.col("slash"), both).otherwise(F.array(one("only", first))))
    return df.withColumn("readings", F.filter("_r", lambda r: r["at"].isNotNull())).drop("_f", "_epoch", "_a", "_b", "_o", "_r")


def _likelihood(at: Column, anchor: Column) -> Column:
    gap = F.abs(at - anchor) / F.lit(86_400e6)
    return F.when(anchor.isNull(), 1.0).otherwise(F.greatest(F.exp(-gap / NEAR_DAYS), F.lit(FAR_LIKELIHOOD)))


def order_mixture(values: DataFrame, declared: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``source, p_dmy``: per source the share of day-first among its slash dates, by expectation-maximisation.

    ``values``: ``source, l_dmy, l_mdy``, the likelihood of each value under both readings (0 for an invalid one).
    Values meet as counts of (source, likelihood ratio in 41 steps), pre-aggregated before the shuffle, so a source of
    any size is one bounded row and the iterations run inside it. ``declared``: ``source, date_order``, a prior.
    """
    ratio = F.round(F.least(F.greatest((F.log(F.col("l_dmy") + 1e-9) - F.log(F.col("l_mdy") + 1e-9)), F.lit(-10.0)), F.lit(10.0)) * 2)
    bins = values.groupBy("source", ratio.alias("ratio")).agg(F.count("*").cast("double").alias("n"))
    one = bins.groupBy("source").agg(F.collect_list(F.struct(F.exp(F.col("ratio") / 2).alias("r"), "n")).alias("bins"))
    one = met(one, declared.select("source", "date_order"), "source", "left", SENT_ROWS)
    prior = F.when(F.col("date_order") == "dmy", 0.98).when(F.col("date_order") == "mdy", 0.02).otherwise(0.5)
    weight = F.when(F.col("date_order").isNotNull(), PRIOR_WEIGHT).otherwise(2.0)
    step = lambda p: F.aggregate("bins", prior * weight, lambda s, b: s + b["n"] * p * b["r"] / (p * b["r"] + 1 - p)) / F.aggregate("bins", weight, lambda s, b: s + b["n"])
    p = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), prior, lambda acc, _: F.least(F.greatest(step(acc), F.lit(1e-6)), F.lit(1 - 1e-6)))
    return one.select("source", p.alias("p_dmy"))


def time_entries(messages: DataFrame, relays: DataFrame) -> DataFrame:
    """One row per time entry: ``msg_id, hop_no, source, text, tz``; hop 0 is ``received_at``, n the n-th of ``received_chain``.

    A chain entry's source is the host after "by"; its text follows the last semicolon. Null texts are kept.
    """
    first = F.struct(F.lit(0).alias("hop_no"), F.lower(F.regexp_extract("from_addr", r"@([^@>\s]+)", 1)).alias("source"), F.col("received_at").alias("text"))
    hops = F.transform(
        F.coalesce("received_chain", F.array().cast("array<string>")),
        lambda x, i: F.struct((i + 1).alias("hop_no"), F.lower(F.regexp_extract(x, r"(?i)\bby\s+([^\s;()]+)", 1)).alias("source"), F.when(F.contains(x, F.lit(";")), F.substring_index(x, ";", -1)).alias("text")),
    )
    rows = messages.select("msg_id", F.explode(F.concat(F.array(first), hops)).alias("e")).select("msg_id", F.col("e.hop_no").cast("bigint").alias("hop_no"), "e.source", "e.text")
    zones = relays.groupBy(F.lower("host").alias("source")).agg(F.max("tz").alias("home"))
    return met(rows, zones, "source", "left", SENT_ROWS).withColumn("tz", F.when(F.col("hop_no") == 0, "UTC").otherwise(F.col("home"))).drop("home")


def resolve_times(entries: DataFrame, relays: DataFrame, texts: bool = True) -> DataFrame:
    """``entries`` with ``at`` (UTC timestamp or null), ``precision``, ``order``, ``posterior``, ``state``; ``text`` only with ``texts``.

    ``state``: ``resolved``, ``ambiguous`` (several valid readings, none with a posterior of ``ACCEPT``), ``undetermined``
    (no valid reading). The anchor of a value is the mean of the single-reading times of its message; a message's
    entries are few, so no group is large even when one source holds a third of all rows. The parsed entries are stored,
    so each text is parsed once, though the mixture and the decision both need it.
    """
    parsed = parse_times(entries, "text", "tz")
    per = F.collect_list(F.struct("hop_no", "source", *(["text"] if texts else []), "readings", "slash", "precision"))
    mean = F.expr("transform(filter(es, e -> size(e.readings) = 1), e -> e.readings[0].at)")
    by = parsed.groupBy("msg_id").agg(per.alias("es")).withColumn("known", mean)
    anchor = F.when(F.size("known") > 0, F.aggregate("known", F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size("known"))
    rows = by.withColumn("anchor", anchor).select("msg_id", "anchor", F.explode("es").alias("e")).select("msg_id", "anchor", "e.*")
    like = lambda order: F.coalesce(F.aggregate("readings", F.lit(None).cast("double"), lambda s, r: F.coalesce(s, F.when(r["order"] == order, _likelihood(r["at"], F.col("anchor"))))), F.lit(0.0))
    slash = F.col("slash") & (F.size("readings") >= 1)
    rows = stored(rows.withColumn("l_dmy", F.when(slash, like("dmy"))).withColumn("l_mdy", F.when(slash, like("mdy"))).drop("anchor"), "times")
    orders = relays.groupBy(F.lower("host").alias("source")).agg(F.max("date_order").alias("date_order"))
    mix = order_mixture(rows.where(slash & F.col("source").isNotNull()), orders).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rows = met(rows.withColumn("salt", F.when(slash, F.pmod(F.xxhash64("msg_id", "hop_no"), F.lit(SALT)).cast("int"))), mix, ["source", "salt"], "left", SENT_ROWS)
    p = F.coalesce("p_dmy", F.lit(0.5))
    first = p * F.col("l_dmy") / (p * F.col("l_dmy") + (1 - p) * F.col("l_mdy"))
    rows = rows.withColumn("first", F.when(slash, first)).withColumn(
        "order", F.when(F.size("readings") == 0, None).when(~slash, F.col("readings")[0]["order"]).when(F.col("first") >= 0.5, "dmy").otherwise("mdy")
    )
    same = F.size(F.array_distinct(F.transform("readings", lambda r: r["at"]))) == 1
    post = F.when(F.col("order").isNull(), None).when(~slash | (same & (F.size("readings") > 1)), 1.0).otherwise(F.greatest(F.col("first"), 1 - F.col("first")))
    state = F.when(F.col("order").isNull(), "undetermined").when(F.col("posterior") >= ACCEPT, "resolved").otherwise("ambiguous")
    at = F.filter("readings", lambda r: r["order"] == F.col("order"))
    rows = rows.withColumn("posterior", post).withColumn("state", state)
    return rows.select("msg_id", "hop_no", "source", *(["text"] if texts else []), "precision", "order", "posterior", "state", F.when(F.col("state") == "resolved", F.timestamp_micros(F.get(at, F.lit(0))["at"])).alias("at"))


def matching_log_rows(resolved: DataFrame, log: DataFrame) -> DataFrame:
    """``msg_id, hop_no, log_id``: log rows whose time, cut to the entry's precision, is the entry's instant."""
    a = resolved.where("at is not null").select("msg_id", "hop_no", "precision", F.unix_micros("at").alias("micros"))
    b = log.select("log_id", "msg_id", "hop_no", F.unix_micros("logged_at").alias("logged"))
    cut = F.col("logged") - F.pmod(F.col("logged"), F.col("precision"))
    return a.join(b, ["msg_id", "hop_no"]).where(cut == F.col("micros")).select("msg_id", "hop_no", "log_id")
