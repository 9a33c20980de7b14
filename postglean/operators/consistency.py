"""Agreement between what a message claims and what it is: identity, links, content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..functions.robust import clamp
from ..functions.text import containment, normalize_text, text_or_empty, token_set
from ..functions.urls import DOMAIN_PATTERN, domain_in_text, host, same_or_sub
from ..policy import Policy
from .headers import clean_domain

# Parts of a declared type that fit an extension.
EXTENSION_TYPES = {
    "pdf": ("application/pdf",), "doc": ("msword",), "docx": ("wordprocessingml",), "docm": ("wordprocessingml", "macroenabled"), "xls": ("ms-excel",),
    "xlsx": ("spreadsheetml",), "xlsm": ("spreadsheetml", "macroenabled"), "ppt": ("ms-powerpoint",), "pptx": ("presentationml",), "zip": ("zip",),
    "jpg": ("image/jpeg", "image/jpg"), "jpeg": ("image/jpeg", "image/jpg"), "png": ("image/png",), "gif": ("image/gif",), "svg": ("image/svg",),
    "html": ("text/html", "html"), "txt": ("text/plain",), "ics": ("calendar",),
}
FEATURES = (
    "display_href_mismatch", "display_domain_mismatch", "sender_identity_mismatch", "replyto_identity_mismatch", "brand_domain_mismatch", "text_url_semantic_mismatch",
    "ocr_url_mismatch", "qr_context_mismatch", "subject_body_mismatch", "attachment_context_mismatch", "brand_visual_domain_mismatch", "identity_history_mismatch",
)


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def belongs_to(domain: Column, domains: tuple[str, ...]) -> Column:
    """Whether the domain is one of ``domains`` or below it."""
    return _any([same_or_sub(domain, F.lit(d)) for d in domains])


def is_lookalike(domain: Column, domains: tuple[str, ...], folded: Column | None = None) -> Column:
    """Whether a domain not of the brand resembles one of its: two edits, one after folding, or the name inside it."""
    folded = F.lower(normalize_text(domain)) if folded is None else folded
    near = [F.levenshtein(domain, F.lit(d), 2).between(0, 2) | F.levenshtein(folded, F.lit(d), 1).between(0, 1) | domain.contains(d.split(".")[0]) for d in domains]
    return (domain != "") & ~belongs_to(domain, domains) & _any(near)


def identity_base(display: Column, subject: Column, from_addr: Column, reply_to: Column) -> dict[str, Column]:
    """What the identity features are made of: domains of sender, reply and display name, the text that may claim a brand."""
    text = F.lower(F.concat_ws(" ", text_or_empty(display), text_or_empty(subject)))
    return {"sender": clean_domain(from_addr), "reply": clean_domain(reply_to), "shown": domain_in_text(display), "text": text}


def claimed_brands(policy: Policy, sender: Column, text: Column, folded: Column | None = None) -> tuple[Column, Column]:
    """Names of the first brand claimed by a sender whose domain resembles its own, and of the first claimed by any other; null without."""
    own = sender != "" if not policy.mailing_domains else ~belongs_to(sender, policy.mailing_domains)
    alike, other = [], []
    for key, (name, domains) in policy.brands.items():
        claimed = (text.contains(key) | text.contains(name.lower())) & ~belongs_to(sender, domains)
        near = is_lookalike(sender, domains, folded)
        alike.append(F.when(claimed & near, name))
        other.append(F.when(claimed & ~near, name))
    none = F.lit(None).cast("string")
    return F.when(own, F.coalesce(*alike, none)), F.when(own, F.coalesce(*other, none))


def identity_scores(policy: Policy, sender: Column, reply: Column, shown: Column, visual: Column, other: Column, history: Column | None = None) -> dict[str, Column]:
    """By name: the five identity features, the domain shown in the display name and the brand claimed."""
    known = belongs_to(reply, tuple(d for _, ds in policy.brands.values() for d in ds))
    differs = (reply != "") & (sender != "") & (reply != sender)
    return {
        "sender_identity_mismatch": F.when((shown != "") & (sender != "") & (shown != sender), 0.8).when(other.isNotNull(), 0.5).otherwise(0.0),
        "replyto_identity_mismatch": F.when(~differs, 0.0).when(known, 0.2).when(belongs_to(reply, policy.mailing_domains), 0.15).otherwise(0.7),
        "brand_domain_mismatch": F.when(visual.isNotNull(), 0.9).when(other.isNotNull(), 0.6).otherwise(0.0),
        "brand_visual_domain_mismatch": F.when(visual.isNotNull(), 0.9).otherwise(0.0),
        "identity_history_mismatch": (F.lit(0.0) if history is None else F.coalesce(history, F.lit(0.0))),
        "display_domain": shown, "claimed_brand": F.coalesce(visual, other),
    }


def identity_features(policy: Policy, display: Column, subject: Column, from_addr: Column, reply_to: Column, folded: Column | None = None, history: Column | None = None) -> dict[str, Column]:
    """:func:`identity_scores` of raw header columns; ``folded`` may give the folded sender domain, ``history`` its mismatch."""
    b = identity_base(display, subject, from_addr, reply_to)
    return identity_scores(policy, b["sender"], b["reply"], b["shown"], *claimed_brands(policy, b["sender"], b["text"], folded), history)


def link_features(urls: Column, image_text: Column, qr_urls: Column, visible: Column) -> dict[str, Column]:
    """By name: the four link features and what they speak of, over the links with shown text, the image's text and the code's targets."""
    shown = F.filter(urls, lambda u: F.trim(text_or_empty(u["display_text"])) != "")
    n = F.size(shown)
    part = lambda f: F.when(n > 0, F.size(F.filter(shown, f)) / n).otherwise(0.0)
    in_text = lambda u: domain_in_text(F.trim(u["display_text"]))
    domains = F.filter(F.transform(urls, lambda u: F.lower(text_or_empty(u["domain"]))), lambda d: d != "")
    seen = F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(image_text)), F.lit(DOMAIN_PATTERN), F.lit(1)))
    codes = F.filter(F.transform(F.coalesce(qr_urls, F.array().cast("array<string>")), host), lambda h: h != "")
    low = F.lower(text_or_empty(visible))
    return {
        "display_href_mismatch": part(lambda u: F.coalesce(u["display_text_mismatch"], F.lit(False))),
        "display_domain_mismatch": part(lambda u: (in_text(u) != "") & (text_or_empty(u["domain"]) != "") & (in_text(u) != u["domain"])),
        "ocr_url_mismatch": F.when((F.size(seen) > 0) & (F.size(domains) == 0), 0.5).when((F.size(seen) > 0) & ~F.arrays_overlap(seen, domains), 0.8).otherwise(0.0),
        "qr_context_mismatch": F.when((F.size(codes) > 0) & ~F.exists(codes, lambda h: F.contains(low, h)), 0.7).otherwise(0.0),
        "links_shown": n, "image_domain": F.array_min(seen), "code_domain": F.array_min(codes),
    }


def declared_type_mismatch(name: Column, declared: Column) -> Column:
    """0.6 where the declared type has no part that fits the extension, else 0."""
    ext = F.when(text_or_empty(name).contains("."), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")
    low = F.lower(text_or_empty(declared))
    wrong = _any([(ext == e) & ~_any([low.contains(p) for p in parts]) for e, parts in EXTENSION_TYPES.items()])
    return F.when((low != "") & wrong, 0.6).otherwise(0.0)


def semantic_features(head: Column, words: Column, urls: Column, attachments: Column) -> dict[str, Column]:
    """By name: the four content features from the word sets of subject and body (``token_set``), links and file names."""
    filled = F.size(words) > 0
    link_words = lambda u: F.array_union(token_set(F.regexp_replace(text_or_empty(u["domain"]), "[.-]", " ")), token_set(u["normalized"]))
    best_link = F.array_max(F.transform(urls, lambda u: containment(link_words(u), words)))
    best_file = F.array_max(F.transform(attachments, lambda a: containment(token_set(a["filename"]), words)))
    return {
        "text_url_semantic_mismatch": F.when(filled & (F.size(urls) > 0), clamp(0.7 - best_link)).otherwise(0.0),
        "subject_body_mismatch": F.when(filled & (F.size(head) > 0), clamp(0.8 - containment(head, words))).otherwise(0.0),
        "attachment_context_mismatch": F.when(filled & (F.size(attachments) > 0), clamp(0.7 - best_file)).otherwise(0.0),
        "attachment_filename_mime_mismatch": F.coalesce(F.array_max(F.transform(attachments, lambda a: declared_type_mismatch(a["filename"], a["content_type"]))), F.lit(0.0)),
    }


def contradiction(features: dict[str, Column]) -> tuple[Column, Column]:
    """Contradiction (features of 0.5 or more, by four) and overall consistency (1 less the greatest)."""
    hits = sum((F.when(features[n] >= 0.5, 1.0).otherwise(0.0) for n in FEATURES), F.lit(0.0))
    return F.round(F.least(hits / 4, F.lit(1.0)), 4), F.round(1 - F.greatest(*[features[n] for n in FEATURES]), 4)
