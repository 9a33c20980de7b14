"""Header rules: failed authentication, domains that differ, suspicious display names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.text import text_or_empty

# Display names of roles, and domains that may use them.
ROLE_NAMES = ("admin", "support", "billing")
ROLE_DOMAINS = ("google.com", "microsoft.com", "amazon.com", "paypal.com")


def raw_domain(address: Column, clean: bool = False) -> Column:
    """What follows the last ``@`` as written ('' without one); ``clean`` drops brackets and blanks and lowers it."""
    a = text_or_empty(address)
    out = F.when(a.contains("@"), F.element_at(F.split(a, "@"), -1)).otherwise("")
    return F.lower(F.regexp_replace(out, "[<> ]", "")) if clean else out


def clean_domain(address: Column) -> Column:
    return raw_domain(address, clean=True)


def auth_failures(headers: Column) -> Column:
    """Struct of three flags from the ``Authentication-Results`` header; a missing header fails nothing."""
    h = F.lower(text_or_empty(F.try_element_at(headers, F.lit("Authentication-Results"))))
    return F.struct(*[h.contains(f"{k}=fail").alias(f"{k}_fail") for k in ("spf", "dkim", "dmarc")])


def header_anomalies(from_addr: Column, return_path: Column, reply_to: Column, display: Column, clean: bool = False) -> Column:
    """Struct of three flags; domains are compared as written unless ``clean``."""
    sender, back, reply = (raw_domain(x, clean) for x in (from_addr, return_path, reply_to))
    differ = lambda d: (sender != "") & (d != "") & (sender != d)
    return F.struct(
        differ(back).alias("from_return_mismatch"),
        differ(reply).alias("from_reply_mismatch"),
        (F.lower(text_or_empty(display)).isin(*ROLE_NAMES) & ~sender.isin(*ROLE_DOMAINS)).alias("display_name_suspicious"),
    )


def anomaly_count(auth: Column, anomalies: Column) -> Column:
    """Number of the six flags that are set, as a double."""
    flags = [auth[f"{k}_fail"] for k in ("spf", "dkim", "dmarc")] + [anomalies[k] for k in ("from_return_mismatch", "from_reply_mismatch", "display_name_suspicious")]
    return sum((f.cast("double") for f in flags), F.lit(0.0))
