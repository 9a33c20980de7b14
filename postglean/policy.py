"""Thresholds, brands and limits as one value, with overrides from a file."""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path

# Protected brands with shown name and their own domains; domains of mailing services.
BRANDS = {
    "microsoft": ("Microsoft", ("microsoft.com", "live.com", "outlook.com", "office.com", "microsoftonline.com")),
    "google": ("Google", ("google.com", "gmail.com", "youtube.com", "googlemail.com")),
    "apple": ("Apple", ("apple.com", "icloud.com")),
    "amazon": ("Amazon", ("amazon.com", "amazon.co.uk", "amazon.de", "aws.amazon.com")),
    "paypal": ("PayPal", ("paypal.com", "paypal.me")),
    "netflix": ("Netflix", ("netflix.com",)),
    "dhl": ("DHL", ("dhl.com", "dhl.de")),
    "fedex": ("FedEx", ("fedex.com",)),
    "dropbox": ("Dropbox", ("dropbox.com",)),
    "linkedin": ("LinkedIn", ("linkedin.com", "lnkd.in")),
}
MAILING_DOMAINS = ("sendgrid.net", "mailchimp.com", "list-manage.com", "constantcontact.com", "mailgun.org", "amazonses.com", "sendinblue.com", "hubspotemail.net", "salesforce.com", "exacttarget.com")
LEARNING = ("always", "only_below_block", "confirmed_only")


@dataclass(frozen=True)
class Policy:
    block: float = 0.85
    flag: float = 0.50
    review: float = 0.70
    uncertainty_gate: float = 0.45
    reason_threshold: float = 0.6
    max_reasons: int = 5
    fix_attachment_risk: bool = False
    normalize_header_domains: bool = False
    #: always, only_below_block or confirmed_only; an unknown mode is an error.
    learn_from: str = "only_below_block"
    #: Reputations and failed authentication raise the risk of markup.
    html_context: bool = False
    brands: dict[str, tuple[str, tuple[str, ...]]] = field(default_factory=lambda: dict(BRANDS))
    mailing_domains: tuple[str, ...] = MAILING_DOMAINS

    def __post_init__(self) -> None:
        if self.learn_from not in LEARNING:
            raise ValueError(f"learn_from is one of {', '.join(LEARNING)}")


#: Key of a policy file by path, field of :class:`Policy`, and how a value is read.
KEYS = (
    (("block_threshold",), "block", float), (("flag_threshold",), "flag", float), (("review_threshold",), "review", float), (("uncertainty_gate",), "uncertainty_gate", float),
    (("reason_threshold",), "reason_threshold", float), (("max_reasons",), "max_reasons", int), (("behavioral", "update_policy"), "learn_from", str), (("fix_attachment_risk",), "fix_attachment_risk", bool),
    (("normalize_header_domains",), "normalize_header_domains", bool), (("html_context",), "html_context", bool), (("mailing_domains",), "mailing_domains", tuple),
    (("brands",), "brands", lambda b: {k.lower(): (str(v.get("display", k)), tuple(map(str, v["domains"]))) for k, v in b.items()}),
)


def load_policy(path: str | None = None, base: Policy | None = None, environment: Mapping[str, str] | None = None) -> Policy:
    """``base`` with what a JSON or YAML file says, then the environment (``POSTGLEAN_<FIELD>`` for single values).

    A missing or unreadable file changes nothing; a value of a wrong kind is left out with a warning. Repeated keys of
    a file: the last counts.
    """
    base = base or Policy()
    data: dict = {}
    if path and Path(path).exists():
        try:
            text = Path(path).read_text(encoding="utf-8")
            if path.endswith((".yaml", ".yml")):
                import yaml

                data = yaml.safe_load(text) or {}
            else:
                data = json.loads(text)
        except (OSError, ValueError, ImportError) as e:
            warnings.warn(f"policy file not read: {e}", stacklevel=2)
    for place, name, read in KEYS:
        value = data
        for k in place:
            value = value.get(k) if isinstance(value, dict) else None
        value = (environment if environment is not None else os.environ).get(f"POSTGLEAN_{name.upper()}", value) if read in (float, int, str, bool) else value
        if value is not None:
            try:
                base = replace(base, **{name: value in (True, "1", "true", "yes") if read is bool else read(value)})
            except (ValueError, TypeError, KeyError, AttributeError) as e:
                warnings.warn(f"policy value {name} left out: {e}", stacklevel=2)
    return base
