"""Arrow functions whose return type is parsed on first use, so that modules import without a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def arrow_function(schema: str) -> Callable[[Callable], Callable[..., Column]]:
    """Decorator: a pandas function with this return type, usable on columns."""

    def wrap(f: Callable) -> Callable[..., Column]:
        made: list[Callable] = []

        def call(*columns) -> Column:
            if not made:
                made.append(F.pandas_udf(f, schema))
            return made[0](*columns)

        call.__doc__ = f.__doc__
        return call

    return wrap
