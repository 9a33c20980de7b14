"""Columns computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each computed once per row: a generator keeps the optimizer from repeating them inline.

    Later expressions may use a column many times without its expression growing into each of them. Existing columns of
    the same names are replaced.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
