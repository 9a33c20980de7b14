"""Bounded samples for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

GRAIN = 1_000_000


def by_hash(rows: DataFrame, key: Column, n: int, total: int) -> DataFrame:
    """At most ``n`` rows, those with the least hash of ``key``; ``total`` is how many rows ``rows`` has.

    Rows are first thinned by the hash to about twice ``n``, so the tasks together send no more than that to the driver
    however many they are.
    """
    keep = GRAIN if total <= 2 * n else max(1, round(GRAIN * 2 * n / total))
    return rows.withColumn("_h", F.xxhash64(key)).where(F.pmod(F.col("_h"), F.lit(GRAIN)) < keep).orderBy("_h").limit(n).drop("_h")
