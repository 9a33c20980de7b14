"""Tactics of a message's text and the intents derived from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..functions.robust import clamp
from ..functions.text import tactic, text_or_empty

# Markers in lower-case text.
LINK_MARKS = ("click here", "click the link", "click below", "follow this link", "verify at", "login at", "sign in at", "http://", "https://")
ATTACHMENT_MARKS = ("attached", "attachment", "open the", "enable macros", "see the file", "download the", "review the document", "open the document")
GIFT_MARKS = ("gift card", "itunes card", "steam card", "google play card")
PASSWORD_MARKS = ("password", "sign in", "log in", "login", "2fa", "verify your identity")
TACTIC_NAMES = ("urgency", "authority_impersonation", "credential_request", "payment_gift_card", "link_bait", "attachment_lure")
INTENT_NAMES = ("credential_harvesting_score", "financial_fraud_score", "account_takeover_score", "business_email_compromise_score", "malicious_attachment_score", "social_engineering_score")


def _has(low: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(m) for m in marks])


def tactics(text: Column, has_urls: Column, has_files: Column, has_qr: Column) -> dict[str, Column]:
    """By name the six tactics; null text reads as ''."""
    low = F.lower(text_or_empty(text))
    urgency, authority = tactic(text, "urgency"), tactic(text, "authority")
    credential = F.greatest(tactic(text, "credential_request"), F.when(_has(low, PASSWORD_MARKS), 0.5).otherwise(0.0))
    payment = F.greatest(tactic(text, "financial"), F.when(_has(low, GIFT_MARKS), 0.7).otherwise(0.0))
    bait = F.when(has_urls & _has(low, LINK_MARKS), 0.6).when(has_urls & ((urgency > 0) | (credential > 0)), 0.4).otherwise(0.0)
    return {
        "urgency": urgency, "authority_impersonation": authority, "credential_request": credential, "payment_gift_card": payment,
        "link_bait": F.greatest(bait, F.when(has_qr, 0.5).otherwise(0.0)), "attachment_lure": F.when(has_files | _has(low, ATTACHMENT_MARKS), 0.6).otherwise(0.0),
    }


def intents(t: dict[str, Column], url_suspicious: Column, brand: Column, replyto: Column, attachment_risk: Column, auth_fail: Column) -> dict[str, Column]:
    """By name: the six derived scores from the tactics and five technical signals."""
    credential, payment, authority, urgency = t["credential_request"], t["payment_gift_card"], t["authority_impersonation"], t["urgency"]
    return {
        INTENT_NAMES[0]: clamp(credential * F.greatest(url_suspicious, brand)),
        INTENT_NAMES[1]: clamp(payment * F.greatest(F.lit(0.4), authority, replyto, 0.9 * urgency)),
        INTENT_NAMES[2]: clamp(credential * F.greatest(brand, auth_fail, F.lit(0.3))),
        INTENT_NAMES[3]: clamp(authority * payment * (0.6 + 0.4 * replyto)),
        INTENT_NAMES[4]: clamp(t["attachment_lure"] * F.greatest(attachment_risk, F.lit(0.3))),
        INTENT_NAMES[5]: clamp(F.greatest(urgency, authority) * (0.5 + 0.5 * F.greatest(t["link_bait"], t["attachment_lure"]))),
    }
