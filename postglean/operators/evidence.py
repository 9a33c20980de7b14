"""Evidence: severity, identity, rank, deduplication and the top of a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.robust import clamp

# Weights of severity and confidence.
SEVERITY = {"info": 0.0, "low": 0.25, "medium": 0.5, "high": 0.75, "critical": 1.0}
CONFIDENCE = {"low": 0.4, "medium": 0.75, "high": 1.0}


def severity(score: Column) -> Column:
    return F.when(score >= 0.9, "critical").when(score >= 0.7, "high").when(score >= 0.4, "medium").when(score > 0, "low").otherwise("info")


def evidence_id(category: Column, feature: Column, value: Column, module: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the four parts; null parts read as ''."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (category, feature, value, module)])), 1, 16)


def _weight(x: Column, table: dict[str, float], default: float) -> Column:
    m = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.coalesce(F.try_element_at(m, x), F.lit(default))


def rank_score(score: Column, sev: Column, confidence: Column) -> Column:
    return F.round(score * _weight(sev, SEVERITY, 0.0) * _weight(confidence, CONFIDENCE, 0.5), 6)


def item(category: Column | str, feature: Column | str, value: Column, score: Column, module: Column | str, sev: Column | None = None, confidence: str = "medium", entity: Column | None = None) -> Column:
    """One evidence struct."""
    category, f, module = (F.lit(x) if isinstance(x, str) else x for x in (category, feature, module))
    s = clamp(score)
    level = severity(s) if sev is None else sev
    v = value.cast("string")
    return F.struct(
        evidence_id(category, f, v, module).alias("evidence_id"), category.alias("category"), f.alias("feature"), v.alias("value"), s.alias("normalized_score"),
        level.alias("severity"), F.lit(confidence).alias("confidence"), module.alias("source_module"), rank_score(s, level, F.lit(confidence)).alias("rank_score"),
        (F.lit(None).cast("string") if entity is None else entity).alias("related_entity"), f.alias("explanation_key"),
    )


def deduplicate(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Per message and evidence_id the strongest row (ties: the first), at the place of the first."""
    w = Window.partitionBy(*keys, "evidence_id")
    best = rows.withColumn("_first", F.min(order).over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.desc("rank_score"), order)))
    return best.where("_n = 1").withColumn(order, F.col("_first")).drop("_n", "_first")


def top(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n strongest rows per message by rank, score, feature, id, with ``position`` from 1."""
    w = Window.partitionBy(*keys).orderBy(F.desc("rank_score"), F.desc("normalized_score"), "feature", "evidence_id")
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def by_category(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per message and category the number of items and the greatest score."""
    return rows.groupBy(*keys, "category").agg(F.count("*").alias("items"), F.max("normalized_score").alias("max_score"))


def ranked(items: Column) -> Column:
    """An array of evidence structs, strongest first, without repeated ids."""
    def less(a: Column, b: Column) -> Column:
        by = lambda x, y, down: F.when(x == y, 0).when((x > y) if down else (x < y), -1).otherwise(1)
        steps = [by(a["rank_score"], b["rank_score"], True), by(a["normalized_score"], b["normalized_score"], True), by(a["feature"], b["feature"], False)]
        last = by(a["evidence_id"], b["evidence_id"], False)
        return F.when(steps[0] != 0, steps[0]).when(steps[1] != 0, steps[1]).when(steps[2] != 0, steps[2]).otherwise(last)

    return F.array_sort(F.array_distinct(items), less)
