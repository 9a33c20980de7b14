"""Metrics, thresholds, splits and disturbed copies for judging scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

BINS = 1000
COSTS = {"false_positive": 1.0, "false_negative": 10.0, "block": 2.0, "review": 0.5}


def curve(rows: DataFrame, score: str = "score", label: str = "label", bins: int = BINS) -> DataFrame:
    """``threshold, tp, fp, fn, tn``: outcomes when scores at or above each of ``bins`` + 1 thresholds count as hits.

    Rows are pre-aggregated by threshold before the cumulative sums, so the window sees at most ``bins`` + 1 rows.
    Null scores and labels are left out.
    """
    at = F.floor(F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)) * bins).cast("int")
    counts = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(at.alias("bin")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("q"))
    spark = rows.sparkSession
    grid = spark.range(bins + 1).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(counts), "bin", "left").fillna(0)
    down = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tp, fp = F.sum("p").over(down), F.sum("q").over(down)
    return grid.select((F.col("bin") / bins).alias("threshold"), tp.alias("tp"), fp.alias("fp"), (F.sum("p").over(every) - tp).alias("fn"), (F.sum("q").over(every) - fp).alias("tn"))


def rates(points: DataFrame) -> DataFrame:
    """Precision, recall, F1 and false-positive rate of each point; a rate without cases is 0."""
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return points.withColumns({"precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "f1": div(2 * tp, 2 * tp + fp + fn), "fpr": div(fp, fp + tn)})


def area(points: DataFrame) -> DataFrame:
    """``roc_auc, pr_auc`` by the trapezoid and the step rule over the thresholds; ``fpr_at_95`` recall."""
    w = Window.orderBy(F.desc("threshold"))
    r = rates(points).withColumns({"x": F.lag("fpr", 1, 0.0).over(w), "y": F.lag("recall", 1, 0.0).over(w)})
    return r.agg(
        F.round(F.sum((F.col("fpr") - F.col("x")) * (F.col("recall") + F.col("y")) / 2), 6).alias("roc_auc"),
        F.round(F.sum((F.col("recall") - F.col("y")) * F.col("precision")), 6).alias("pr_auc"),
        F.round(F.min(F.when(F.col("recall") >= 0.95, F.col("fpr"))), 6).alias("fpr_at_95"),
    )


def cheapest(points: DataFrame, costs: dict[str, float] | None = None, review_width: float = 0.15, bins: int = BINS) -> DataFrame:
    """The threshold with the least cost (ties: the least threshold): missed and false hits, and the handling of messages.

    Scores from the threshold on are blocked, those at most ``review_width`` below it are reviewed; both cost their share.
    """
    c = COSTS | (costs or {})
    hits = F.col("tp") + F.col("fp")
    lower = F.first(hits).over(Window.orderBy("threshold").rowsBetween(-round(review_width * bins), 0))  # at most bins + 1 rows
    out = points.withColumns({"blocked": hits, "reviewed": lower - hits})
    cost = F.col("fp") * c["false_positive"] + F.col("fn") * c["false_negative"] + F.col("blocked") * c["block"] + F.col("reviewed") * c["review"]
    return out.withColumn("cost", cost).orderBy("cost", "threshold").limit(1)


def isotonic(rows: DataFrame, score: str = "score", label: str = "label", bins: int = BINS) -> DataFrame:
    """``bin, n, rate, calibrated``: per score bin the share of hits and its isotonic (never falling) fit.

    The fit of a bin is the greatest, over starts at or below it, of the least mean up to an end at or above it. Rows are
    pre-aggregated, so at most ``bins`` + 1 of them meet.
    """
    at = F.floor(F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)) * bins).cast("int")
    own = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("y"))
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = cut_lineage(own.select("bin", "n", "y", F.sum("n").over(w).alias("sn"), F.sum("y").over(w).alias("sy")))
    first = sums.select(F.col("bin").alias("a"), (F.col("sn") - F.col("n")).alias("an"), (F.col("sy") - F.col("y")).alias("ay"))
    spans = first.join(F.broadcast(sums.select("bin", "sn", "sy")), F.col("a") <= F.col("bin")).withColumn("mean", (F.col("sy") - F.col("ay")) / (F.col("sn") - F.col("an")))
    least = spans.withColumn("m", F.min("mean").over(Window.partitionBy("a").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)))
    fit = least.groupBy("bin").agg(F.max("m").alias("calibrated"))
    return own.join(fit, "bin").select("bin", "n", (F.col("y") / F.col("n")).alias("rate"), "calibrated")


def calibrated(rows: DataFrame, fit: DataFrame, score: str = "score", bins: int = BINS) -> DataFrame:
    """``rows`` with ``calibrated``: the fit of the greatest fitted bin at or below the score's (of the least one for lower scores)."""
    at = F.floor(F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)) * bins).cast("int")
    table = F.sort_array(F.collect_list(F.struct("bin", "calibrated")))
    held = rows.crossJoin(F.broadcast(fit.agg(table.alias("_t"))))  # one row of at most bins + 1 pairs
    below = F.filter("_t", lambda x: x["bin"] <= at)
    return held.withColumn("calibrated", F.coalesce(F.try_element_at(below, F.lit(-1))["calibrated"], F.get("_t", F.lit(0))["calibrated"])).drop("_t")


def split(rows: DataFrame, group: str, shares: tuple[tuple[str, float], ...] = (("train", 0.8), ("valid", 0.1), ("test", 0.1)), salt: str = "") -> DataFrame:
    """``rows`` with ``part``, by a hash of the group: a group is never divided. Null groups are one group."""
    u = F.conv(F.substring(F.sha1(F.concat(F.lit(salt), F.coalesce(F.col(group).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    edge, out = 0.0, None
    for name, share in shares:
        edge += share
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    return rows.withColumn("part", out.otherwise(shares[-1][0]))


def leakage(rows: DataFrame, fingerprint: Column) -> DataFrame:
    """``fingerprint, parts, n`` of contents that stand in more than one part."""
    return rows.groupBy(fingerprint.alias("fingerprint")).agg(F.array_sort(F.collect_set("part")).alias("parts"), F.count("*").alias("n")).where(F.size("parts") > 1)


def checked_split(rows: DataFrame, group: str, fingerprint: Column, tolerance: float = 0.0, shares: tuple[tuple[str, float], ...] = (("train", 0.8), ("valid", 0.1), ("test", 0.1))) -> DataFrame:
    """:func:`split` whose rows with contents in several parts are at most ``tolerance`` of all; beyond it this raises."""
    made = split(rows, group, shares)
    n, bad = rows.count(), leakage(made, fingerprint).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if bad > tolerance * n:
        raise ValueError(f"{bad} of {n} rows have contents in several parts, more than {tolerance:.4f} of them")
    return made


#: Disturbances of a text that leave its reading: name and column expression.
MUTATIONS: dict[str, Callable[[Column], Column]] = {
    "zero_width": lambda x: F.regexp_replace(x, "([aeiou])", "$1​"),
    "soft_hyphen": lambda x: F.regexp_replace(x, "(\\w{3})(\\w)", "$1­$2"),
    "homoglyph": lambda x: F.translate(x, "aeopc", "аеорс"),
    "digits": lambda x: F.translate(x, "oles", "0135"),
    "upper": F.upper,
    "lower": F.lower,
    "title": F.initcap,
    "double_space": lambda x: F.replace(x, F.lit(" "), F.lit("  ")),
    "no_break_space": lambda x: F.replace(x, F.lit(" "), F.lit(" ")),
    "no_space": lambda x: F.replace(x, F.lit(" "), F.lit("")),
    "line_breaks": lambda x: F.replace(x, F.lit(". "), F.lit(".\n")),
    "punctuation": lambda x: F.regexp_replace(x, r"[.,;:!?]", ""),
    "defanged": lambda x: F.replace(F.regexp_replace(x, "(?i)http(s?)://", "hxxp$1://"), F.lit("."), F.lit("[.]")),
    "percent": lambda x: F.regexp_replace(x, "/", "%2F"),
    "full_width": lambda x: F.translate(x, "abcdefghijklmnopqrstuvwxyz", "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"),
    "reversed_words": lambda x: F.concat_ws(" ", F.reverse(F.split(x, " "))),
    "prefix": lambda x: F.concat(F.lit("Hello, as agreed. "), x),
    "suffix": lambda x: F.concat(x, F.lit(" Kind regards, the team")),
    "bidi": lambda x: F.concat(F.lit("‪"), x, F.lit("‬")),
}


def disturbed(rows: DataFrame, column: str) -> DataFrame:
    """Each row once per mutation with ``mutation`` and the changed ``column``; null texts stay null."""
    made = F.array(*[F.struct(F.lit(n).alias("mutation"), f(F.col(column)).alias("text")) for n, f in MUTATIONS.items()])
    rest = [c for c in rows.columns if c != column]
    return rows.select(*rest, F.explode(made).alias("_m")).select(*rest, "_m.mutation", F.col("_m.text").alias(column))


def differential(base: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """``mutation, n, changed_level, mean_shift`` of verdicts (``key, level, score``) against those of disturbed copies."""
    b = base.select(key, F.col("level").alias("_l"), F.col("score").alias("_s"))
    return changed.join(b, key).groupBy("mutation").agg(F.count("*").alias("n"), F.sum((F.col("level") != F.col("_l")).cast("int")).alias("changed_level"), F.round(F.avg(F.col("score") - F.col("_s")), 6).alias("mean_shift"))
