"""Link functions on texts and on the link structs of a message."""

from __future__ import annotations

from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .arrow import arrow_function
from .text import BIDI, ZERO_WIDTH, entropy, nfkc, text_or_empty

# Top-level domains taken as risky, words of lures in addresses.
RISKY_TLDS = ("zip", "mov", "xyz", "top", "club", "live", "click", "ru", "tk", "gq", "cf", "work")
LURE_WORDS = ("login", "verify", "secure", "account", "update", "confirm", "password", "signin")
URL_PATTERN = r"(?i)h?t?t?ps?://[^\s<>\"')]+"
DOMAIN_PATTERN = r"(?i)\b([a-z0-9-]+(?:\.[a-z0-9-]+)+)\b"


@arrow_function("string")
def percent_decoded(x: pd.Series) -> pd.Series:
    """Percent escapes resolved as UTF-8; a plus stays, a broken escape stays."""
    return x.map(lambda t: t if t is None or "%" not in t else unquote(t))


def authority(url: Column) -> Column:
    """What stands between ``://`` and the next ``/`` or ``?``, after the last ``@``; port, case and fragment stay."""
    rest = F.when(url.contains("://"), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(url)
    return F.trim(F.element_at(F.split(F.split(F.split(rest, "/")[0], r"\?")[0], "@"), -1))


def scheme(url: Column) -> Column:
    return F.when(url.contains("://"), F.lower(F.split(url, "://")[0])).otherwise("")


def normalize_url(url: Column) -> Column:
    """Trimmed, NFKC, marks dropped, percent escapes resolved, ``hxxp(s)`` and bracketed dots restored."""
    x = F.regexp_replace(F.regexp_replace(nfkc(F.trim(text_or_empty(url))), ZERO_WIDTH, ""), BIDI, "")
    x = F.regexp_replace(percent_decoded(x), "(?i)hxxps?://", "http://")
    return F.replace(F.replace(x, F.lit("[.]"), F.lit(".")), F.lit("(.)"), F.lit("."))


def url_record(raw: Column, display: Column) -> Column:
    """Link struct of a raw address and its shown text."""
    normal = normalize_url(raw)
    domain = F.lower(authority(normal))
    shown = text_or_empty(display)
    return F.struct(
        raw.alias("raw_url"), normal.alias("normalized"), domain.alias("domain"),
        F.when(domain.contains("."), F.element_at(F.split(domain, r"\."), -1)).otherwise("").alias("tld"),
        domain.contains("xn--").alias("is_punycode"), ((shown != "") & (domain != "") & ~F.contains(shown, domain)).alias("display_text_mismatch"),
        shown.alias("display_text"), scheme(raw).alias("scheme"),
    )


def urls_in_text(x: Column) -> Column:
    """Addresses in order of appearance, repeats kept, without closing punctuation. Null gives none."""
    return F.transform(F.regexp_extract_all(text_or_empty(x), F.lit(URL_PATTERN), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;)]+$", ""))


def host(url: Column) -> Column:
    """Host in lower case without user and port, '' where there is none."""
    found = F.regexp_extract(text_or_empty(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return F.lower(F.regexp_replace(found, r"[\[\]]", ""))


def domain_in_text(x: Column) -> Column:
    return F.lower(F.regexp_extract(text_or_empty(x), DOMAIN_PATTERN, 1))


def same_or_sub(domain: Column, of: Column) -> Column:
    return (domain == of) | F.endswith(domain, F.concat(F.lit("."), of))


def is_external(url: Column, sender_domain: Column) -> Column:
    """Whether the address has a host outside the sender's domain; without sender domain every host is."""
    h = host(url)
    sender = F.lower(text_or_empty(sender_domain))
    return (h != "") & ~F.startswith(F.lower(F.trim(url)), F.lit("data:")) & ((sender == "") | ~same_or_sub(h, sender))


def looks_like_url(x: Column) -> Column:
    t = F.trim(text_or_empty(x))
    return t.rlike(r"(?i)^(https?://|www\.)") | t.rlike(r"(?i)^[a-z0-9-]+(\.[a-z0-9-]+)+$")


def suspicion(urls: Column) -> Column:
    """Largest suspicion of the links of a message; 0 without links."""

    def one(u: Column) -> Column:
        domain = F.lower(text_or_empty(u["domain"]))
        label = F.split(domain, r"\.")[0]
        tld = F.when(domain.contains("."), F.element_at(F.split(domain, r"\."), -1)).otherwise("")
        return F.greatest(
            F.when(u["is_punycode"], 0.8).otherwise(0.0),
            F.when((domain != "") & u["display_text_mismatch"], 0.7).otherwise(0.0),
            F.when(text_or_empty(u["raw_url"]).contains("@"), 0.7).otherwise(0.0),
            F.when(tld.isin(*RISKY_TLDS), 0.5).otherwise(0.0),
            F.when((domain != "") & label.rlike(r"[0-9-]"), 0.4).otherwise(0.0),
        )

    return F.coalesce(F.array_max(F.transform(urls, one)), F.lit(0.0))


def lexical_features(url: Column) -> Column:
    """Struct of length, digit share, sub-domain depth, entropy and flags of an address."""
    h = host(url)
    n = F.length(url)
    return F.struct(
        n.cast("bigint").alias("url_length"),
        F.when(n > 0, F.length(F.regexp_replace(url, "[^0-9]", "")) / n).otherwise(0.0).alias("digit_ratio"),
        F.greatest(F.size(F.split(h, r"\.")) - 2, F.lit(0)).cast("bigint").alias("subdomain_depth"),
        entropy(h).alias("host_entropy"),
        F.element_at(F.split(h, r"\."), -1).isin(*RISKY_TLDS).alias("risky_tld"),
        url.contains("@").alias("has_at"),
        h.contains("xn--").alias("is_punycode"),
        F.lower(url).rlike("|".join(LURE_WORDS)).alias("has_lure_word"),
    )


def in_feeds(links: DataFrame, feeds: DataFrame, column: str = "domain") -> DataFrame:
    """Rows of ``links`` whose ``column`` stands in ``feeds``; a semi join, so repeated feed rows change nothing."""
    return links.join(feeds.select(column).distinct(), column, "left_semi")


def expand_redirects(links: DataFrame, redirects: DataFrame, hops: int = 5) -> DataFrame:
    """``links`` (src) with ``target`` and ``hops`` after following ``redirects`` (src, dst) at most ``hops`` times.

    A source with several targets follows the least; null targets end the chain.
    """
    one = redirects.where("src is not null and dst is not null").groupBy(F.col("src").alias("_s")).agg(F.min("dst").alias("_d"))
    out = links.withColumn("target", F.col("src")).withColumn("hops", F.lit(0))
    for _ in range(hops):
        out = out.join(one, out["target"] == one["_s"], "left").withColumn("hops", F.col("hops") + F.when(F.col("_d").isNotNull(), 1).otherwise(0)).withColumn("target", F.coalesce("_d", "target")).drop("_s", "_d")
    return out
