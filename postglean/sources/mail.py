"""Raw mail to typed records: one Arrow function on the standard mail parser."""

from __future__ import annotations

import re
import unicodedata
from email import message_from_bytes, policy
from email.utils import getaddresses, parseaddr, parsedate_to_datetime
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.arrow import arrow_function
from ..functions.text import BIDI, ZERO_WIDTH
from ..operators.markup import measure

BODY_LIMIT, FILE_LIMIT = 2 << 20, 10 << 20
URL = re.compile(r"h?t?t?ps?://[^\s<>\"')]+", re.I)
MACRO_NAMES = (".docm", ".xlsm", ".pptm")
SCHEMA = (
    "subject string, from_addr string, from_display string, reply_to string, return_path string, recipients array<string>, cc array<string>, headers map<string,string>, received_chain array<string>, "
    "spf_result string, dkim_result string, dmarc_result string, body_plain string, body_html string, visible_text string, links array<struct<href:string,text:string>>, "
    "attachments array<struct<filename:string,content_type:string,size:bigint,has_macros:boolean,payload:binary>>, received_at timestamp, offset_minutes int, cut boolean, degraded boolean"
)
NAMES = [p.split()[0] for p in re.split(r", (?=\w+ )", SCHEMA)]
EMPTY = {n: None for n in NAMES}


def normal_form(url: str) -> str:
    """The form links are compared by: as ``urls.normalize_url``, for one text."""
    x = re.sub(BIDI, "", re.sub(ZERO_WIDTH, "", unicodedata.normalize("NFKC", url.strip())))
    return re.sub("(?i)hxxps?://", "http://", unquote(x)).replace("[.]", ".").replace("(.)", ".")


def _result(text: str, name: str) -> str:
    low = text.lower()
    return "fail" if f"{name}=fail" in low else "pass" if f"{name}=pass" in low else "none"


def parse(raw: bytes | None, body_limit: int = BODY_LIMIT, file_limit: int = FILE_LIMIT) -> dict:
    """Record of one message. Text parts are joined by a space; HTML gives the visible text and links where there is one.

    Bodies are cut to ``body_limit`` characters, payloads to ``file_limit`` bytes (sizes are not), which ``cut`` tells; a date without zone is
    UTC, an unreadable one null. Null gives an empty record.
    """
    m = message_from_bytes(raw or b"", policy=policy.compat32)
    head = {k: str(v) for k, v in m.items()}
    plain, html, files = [], [], []
    for part in m.walk():
        if part.is_multipart():
            continue
        kind, name = part.get_content_type(), part.get_filename()
        data = part.get_payload(decode=True) or b""
        if part.get_content_disposition() == "attachment" or name or kind not in ("text/plain", "text/html"):
            name = name or "unknown"
            files.append({"filename": name, "content_type": kind, "size": len(data), "has_macros": name.lower().endswith(MACRO_NAMES), "payload": data[:file_limit]})
            continue
        try:
            text = data.decode(part.get_content_charset() or "utf-8", "replace")
        except LookupError:  # unknown charset name
            text = data.decode("utf-8", "replace")
        (html if kind == "text/html" else plain).append(text)
    body, markup = " ".join(plain), " ".join(html)
    cut = max(len(body), len(markup)) > body_limit or any(f["size"] > file_limit for f in files)
    body, markup = body[:body_limit], markup[:body_limit]
    display, address = parseaddr(head.get("From", ""))
    found = measure(markup, address.rpartition("@")[2]) if markup else None
    seen = {}
    if found:  # anchors first, then addresses in the text outside of them; of equal normal forms the first stays
        for a in [*found["links"], *({"href": u.rstrip(".,;)"), "text": ""} for u in URL.findall(found["own_text"]))]:
            seen.setdefault(normal_form(a["href"]), a)
    links = list(seen.values()) if found else [{"href": u.rstrip(".,;)"), "text": ""} for u in URL.findall(body)]
    at, offset = None, None
    try:
        when = parsedate_to_datetime(head["Date"])
        offset = int(when.utcoffset().total_seconds() // 60) if when.tzinfo else 0
        at = pd.Timestamp(when).tz_localize("UTC") if when.tzinfo is None else pd.Timestamp(when).tz_convert("UTC")
    except (KeyError, TypeError, ValueError):
        pass
    auth = head.get("Authentication-Results", "")
    return {
        "subject": head.get("Subject", ""), "from_addr": address, "from_display": display, "reply_to": head.get("Reply-To", ""), "return_path": head.get("Return-Path", ""),
        "recipients": [a for _, a in getaddresses(m.get_all("To", [])) if a], "cc": [a for _, a in getaddresses(m.get_all("Cc", [])) if a], "headers": head, "received_chain": [str(x) for x in m.get_all("Received", [])],
        **{f"{k}_result": _result(auth, k) for k in ("spf", "dkim", "dmarc")}, "body_plain": body, "body_html": markup, "visible_text": found["visible_text"] if found else body,
        "links": links, "attachments": files, "received_at": at, "offset_minutes": offset, "cut": cut, "degraded": False,
    }


@arrow_function(SCHEMA)
def parsed(raw: pd.Series) -> pd.DataFrame:
    """:func:`parse` of each row; a message that can't be read gives an empty record marked ``degraded``."""

    def safe(r):
        try:
            return parse(r)
        except Exception:  # one bad message must not end the task
            return parse(b"") | {"degraded": True}

    out = pd.DataFrame([safe(r) for r in raw], columns=NAMES)
    out["received_at"] = pd.to_datetime(out["received_at"], utc=True).dt.tz_convert("UTC")
    out["offset_minutes"] = out["offset_minutes"].astype("Int32")
    return out


def parse_messages(rows: DataFrame, column: str = "raw") -> DataFrame:
    """``rows`` with the record's fields in place of the raw column, each message parsed once; links become structs."""
    from ..functions.urls import url_record

    out = rows.withColumn("_p", parsed(column)).select(*[c for c in rows.columns if c != column], "_p.*")
    return out.withColumn("urls", F.transform("links", lambda a: F.struct(a["href"].alias("raw_url"), a["text"].alias("display_text")))).drop("links")


def read_mail(spark, path: str) -> DataFrame:
    """Messages of ``.eml`` files under ``path``, with ``path`` and the parsed record."""
    return parse_messages(spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(path).select("path", F.col("content").alias("raw")))
