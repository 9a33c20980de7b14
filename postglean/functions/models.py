"""Places where trained models and image readers are plugged in; without them the defaults say nothing new."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .arrow import arrow_function
from .text import phrase_probability

#: Words of a text that a classifier sees.
MODEL_WORDS = 512


def text_probability(text: Column, model: Callable[[Sequence[str]], Sequence[float]] | None = None) -> Column:
    """Phishing probability of a text: the phrase ladder, or a model of batches of texts, which may give none for a text it can't read."""
    if model is None:
        return phrase_probability(text)

    @arrow_function("double")
    def judged(texts: pd.Series) -> pd.Series:
        own = [" ".join((t or "").split()[:MODEL_WORDS]) for t in texts]
        try:
            return pd.Series(list(model(own)), dtype="float64")
        except Exception:  # a failing model must not end the task
            return pd.Series([None] * len(own), dtype="float64")

    return F.coalesce(judged(text), phrase_probability(text))


def image_texts(files: DataFrame, read_text: Callable[[bytes], str] | None = None, read_codes: Callable[[bytes], Sequence[str]] | None = None, column: str = "payload") -> DataFrame:
    """``files`` with ``image_text`` and ``code_urls``: what the given readers find, '' and none without them or where they fail.

    Of the contents of codes only web addresses are kept.
    """

    @arrow_function("image_text string, code_urls array<string>")
    def found(payloads: pd.Series) -> pd.DataFrame:
        def one(p):
            text, codes = "", []
            try:
                text = read_text(bytes(p)) if read_text and p is not None else ""
                codes = [c for c in read_codes(bytes(p)) if c.lower().startswith("http")] if read_codes and p is not None else []
            except Exception:  # best effort: an unreadable image says nothing
                pass
            return {"image_text": text or "", "code_urls": codes}

        return pd.DataFrame([one(p) for p in payloads], columns=["image_text", "code_urls"])

    return files.withColumn("_i", found(column)).select("*", "_i.*").drop("_i")
