"""Point-in-time windows over hot keys: a key's rows are cut into blocks of time, and what earlier blocks add up to is carried in.

A window partition is one task, so a key with a third of all rows would be one task. Keys above a size are cut at hours
into blocks of at least so many rows; running sums and maxima of a block start from those of the blocks before, which
come from a pre-aggregated table, and windows of recent rows see a copy of the last rows of the block before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage, met

#: Rows of a block at least, and rows of small tables that are sent to every task.
BLOCK_ROWS, SENT_ROWS = 10_000, 100_000


def blocked(rows: DataFrame, keys: list[str], time: str, size: int = BLOCK_ROWS) -> tuple[DataFrame, bool]:
    """``rows`` with ``_block`` (0 for all keys of up to ``size`` rows), and whether any key was cut.

    Rows are counted per key and hour before the shuffle; the hours of a hot key are laid into blocks in order. Rows
    of one hour, and rows without a time, stay together.
    """
    hour = F.coalesce(F.floor(F.unix_micros(time) / 3_600_000_000), F.lit(-(1 << 40))).cast("bigint")
    hours = cut_lineage(rows.groupBy(*keys, hour.alias("_hour")).agg(F.count("*").alias("n")))
    hot = hours.groupBy(*keys).agg(F.sum("n").alias("all")).where(F.col("all") > size).select(*keys)
    if hot.isEmpty():
        return rows.withColumn("_block", F.lit(0)), False
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    of_hot = hours.alias("h").join(hot.alias("k").hint("merge"), same(hours, hot)[0] if len(keys) == 1 else _all(same(hours, hot))).select("h.*")
    listed = of_hot.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_hour", "n"))).alias("l"))
    state = F.struct(F.lit(0).alias("block"), F.lit(0).cast("bigint").alias("held"), F.array().cast("array<struct<_hour:bigint,_block:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        full = a["held"] >= size
        block = F.when(full, a["block"] + 1).otherwise(a["block"])
        return F.struct(block.alias("block"), (F.when(full, 0).otherwise(a["held"]) + x["n"]).alias("held"), F.concat(a["out"], F.array(F.struct(x["_hour"].alias("_hour"), block.alias("_block")))).alias("out"))

    placed = cut_lineage(listed.select(*keys, F.explode(F.aggregate("l", state, step)["out"]).alias("p")).select(*keys, "p._hour", F.col("p._block").alias("_b")))
    out = met(rows.withColumn("_hour", hour), placed, [*keys, "_hour"], "left", SENT_ROWS).withColumn("_block", F.coalesce("_b", F.lit(0)))
    return out.drop("_hour", "_b"), True


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], maxima: dict[str, Column], cut: bool) -> DataFrame:
    """``rows`` with the sums (0 without rows) and maxima (null without) of all earlier rows of equal ``keys``; ``rows`` has ``_block``."""
    w = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    made = {**{n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()}, **{n: F.max(c).over(w) for n, c in maxima.items()}}
    out = rows.withColumns(made)
    if not cut:
        return out
    parts = rows.groupBy(*keys, "_block").agg(*[F.sum(c).alias(n) for n, c in sums.items()], *[F.max(c).alias(n) for n, c in maxima.items()])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(n).over(before).alias(f"_c_{n}") for n in sums] + [F.max(n).over(before).alias(f"_c_{n}") for n in maxima]
    carry = cut_lineage(parts.select(*keys, "_block", *carried).where("_block > 0"))
    out = met(out, carry, [*keys, "_block"], "left", SENT_ROWS)
    whole = {n: F.col(n) + F.coalesce(f"_c_{n}", F.lit(0)) for n in sums} | {n: F.greatest(n, f"_c_{n}") for n in maxima}
    return out.withColumns(whole).drop(*[f"_c_{n}" for n in (*sums, *maxima)])


def with_recent(rows: DataFrame, keys: list[str], order: list[str], n: int, cut: bool) -> DataFrame:
    """``rows`` marked ``_own``, with copies of the last ``n`` rows of every block in the next one, not ``_own``.

    A block has at least ``BLOCK_ROWS`` rows, which must be no fewer than ``n``.
    """
    own = rows.withColumn("_own", F.lit(True))
    if not cut:
        return own
    w = Window.partitionBy(*keys, "_block").orderBy(*[F.desc(c) for c in order])
    last = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
    blocks = rows.groupBy(*keys).agg(F.max("_block").alias("_most")).where("_most > 0")
    copies = met(last, blocks, keys, limit=SENT_ROWS).where("_block < _most").drop("_most")
    return own.unionByName(copies.withColumn("_block", F.col("_block") + 1).withColumn("_own", F.lit(False)))
