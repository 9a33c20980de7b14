"""Queries of the general data problems (event features, times) with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import event_features as ef, timestamps as ts
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _events(spark: SparkSession, folder: str) -> tuple[DataFrame, list[ef.EventType] | None]:
    verdicts = table(spark, folder, "verdicts")
    return ef.scored_events(table(spark, folder, "emails"), verdicts), ef.event_types(verdicts)


def p4_cells(spark: SparkSession, folder: str) -> DataFrame:
    return ef.found_cells(*_events(spark, folder)).withColumn("total_score", F.round("total_score", 6))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_cells(spark, folder).select("sender", "verdict", "reason", "last_mailbox", "last_uid")


def p4_features(spark: SparkSession, folder: str) -> DataFrame:
    """One row per sender, three columns per type; more types than ``ef.MAX_TYPES`` have no such table."""
    events, types = _events(spark, folder)
    if types is None:
        raise ValueError(f"more than {ef.MAX_TYPES} event types can't be columns; read p4_cells")
    return ef.feature_table(events, types)


def _resolved(spark: SparkSession, folder: str, texts: bool) -> DataFrame:
    relays = table(spark, folder, "relays")
    return ts.resolve_times(ts.time_entries(table(spark, folder, "messages"), relays), relays, texts)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return ts.matching_log_rows(_resolved(spark, folder, False), table(spark, folder, "delivery_log"))


def p6_instants(spark: SparkSession, folder: str) -> DataFrame:
    return _resolved(spark, folder, True)


def queries() -> dict[str, Query]:
    return {"p4_found": p4_found, "p4_cells": p4_cells, "p4_features": p4_features, "p6_found": p6_found, "p6_instants": p6_instants}


_EVENTS = r"""
WITH a AS (SELECT mailbox, uid, received_at,
    CASE WHEN regexp_matches(sender, '<\s*(mailto:)?[^<>\s@]+@[^<>\s@]+\s*>\s*$') THEN regexp_extract(sender, '<\s*(?:mailto:)?([^<>\s@]+@[^<>\s@]+)\s*>\s*$', 1)
    ELSE nullif(regexp_extract(regexp_replace(sender, '"[^"]*"|\([^()]*\)|^\s*(?i:mailto):', ' ', 'g'), '([^\s<>()\[\],;:@"]+@[^\s<>()\[\],;:@"]+)', 1), '') END AS sender FROM emails),
mail AS (SELECT mailbox, uid, lower(max(lower(sender))) AS sender, max(received_at) AS received_at FROM a GROUP BY ALL HAVING max(sender) IS NOT NULL AND max(received_at) IS NOT NULL),
v AS (SELECT mailbox, uid, created_at, upper(regexp_replace(verdict, '\s+', '', 'g')) AS verdict, reasons_json, score FROM verdicts WHERE trim(verdict) <> ''),
last AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY mailbox, uid ORDER BY created_at DESC NULLS LAST, verdict DESC, reasons_json DESC NULLS LAST, score DESC NULLS LAST) = 1),
codes AS (SELECT sender, received_at, mailbox, uid, score, verdict,
    list_distinct(list_filter(coalesce(TRY_CAST(TRY_CAST(reasons_json AS JSON) AS VARCHAR[]), []), lambda x: x IS NOT NULL AND x <> '')) AS c FROM mail JOIN last USING (mailbox, uid)),
events AS (SELECT sender, received_at, mailbox, uid, score, verdict, unnest(CASE WHEN len(c) > 0 THEN c ELSE [''] END) AS reason FROM codes),
cells AS (SELECT sender, verdict, reason, count(*) AS n, round(sum(score), 6) AS total_score, max(received_at) AS last_at, max({'t': received_at, 'm': mailbox, 'u': uid}) AS l FROM events GROUP BY 1, 2, 3)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _EVENTS + "SELECT sender, verdict, reason, l.m AS last_mailbox, l.u AS last_uid FROM cells",
        "p4_cells": _EVENTS + "SELECT sender, verdict, reason, n, total_score, last_at, l.m AS last_mailbox, l.u AS last_uid FROM cells",
    }
