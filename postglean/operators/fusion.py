"""Score, calibrated probability, uncertainty, decision, reasons and explanation of a message."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.robust import clamp
from ..functions.text import TACTICS
from ..policy import Policy

COMPONENTS = ("text", "url", "headers", "html", "behavioral", "attachment", "graph", "consistency")
LEVELS = ("ALLOW", "FLAG", "REVIEW", "BLOCK")
#: Our own words for each kind of reason.
WORDING = {
    "urgency": "Pressure to act at once.",
    "authority": "Speaks in the name of a superior or an authority.",
    "credential": "Asks for sign-in data.",
    "financial": "Asks for a payment or touches an invoice.",
    "headers": "Sender, reply and return addresses don't agree.",
    "general": "Text resembles known phishing.",
}


def raw_score(text_probability: Column, header_count: Column) -> Column:
    """Text probability plus a tenth if any header rule fired; not limited to 1."""
    return text_probability + F.when(header_count > 0, 0.1).otherwise(0.0)


def calibrate(score: Column) -> Column:
    return clamp(score)


def decide(probability: Column, uncertainty: Column, policy: Policy) -> Column:
    """ALLOW, FLAG, REVIEW or BLOCK; high risk with an uncertainty at the gate or above goes to REVIEW."""
    unsure = uncertainty >= policy.uncertainty_gate
    return (
        F.when((probability >= policy.block) & unsure, "REVIEW").when(probability >= policy.block, "BLOCK")
        .when((probability >= policy.review) & unsure, "REVIEW").when(probability >= policy.flag, "FLAG").otherwise("ALLOW")
    )


def disagreement(risks: Column) -> Column:
    """Twice the mean absolute deviation of the risks from their mean, at most 1; 0 for fewer than two."""
    n = F.size(risks)
    mean = F.aggregate(risks, F.lit(0.0), lambda s, v: s + v) / n
    spread = F.aggregate(F.transform(risks, lambda v: F.abs(v - mean)), F.lit(0.0), lambda s, v: s + v) / n
    return F.when(n >= 2, clamp(2 * spread)).otherwise(0.0)


def uncertainty_report(d: Column, missing: Column | int, probability: Column) -> dict[str, Column]:
    """Uncertainty, confidence, margin, agreement and disagreement, rounded to 4 places.

    ``d``: the :func:`disagreement` of the non-null component risks; ``missing``: how many of the eight components gave none.
    """
    margin = clamp(F.abs(probability - 0.5) * 2)
    u = clamp(0.7 * d + 0.2 * missing / len(COMPONENTS) + 0.1 * (1 - margin))
    sure = clamp(F.greatest(probability, 1 - probability) * (1 - 0.5 * u))
    return {"uncertainty": F.round(u, 4), "confidence": F.round(sure, 4), "margin": F.round(margin, 4), "component_agreement": F.round(1 - d, 4), "component_disagreement": F.round(d, 4)}


def reasons(tactic_scores: dict[str, Column], threshold: float) -> Column:
    """``High <tactic> confidence: <value>`` for each tactic above the threshold, in fixed order."""
    made = [F.when(tactic_scores[n] > threshold, F.format_string(f"High {n} confidence: %.2f", tactic_scores[n])) for n, _, _ in TACTICS]
    return F.array_compact(F.array(*made))


def explain(level: Column, why: Column, header_count: Column, top_evidence: Column, agreement: Column, disagree: Column, probability: Column, uncertainty: Column, policy: Policy) -> Column:
    """Numbered Markdown lines: reasons, header line, strongest evidence, agreement, and the ground of a review."""
    calm = level == "ALLOW"
    said = F.transform(why, lambda r: F.coalesce(*[F.when(r.contains(k), WORDING[k]) for k in ("urgency", "authority", "credential", "financial")]))
    lines = F.filter(said, lambda x: x.isNotNull())
    lines = F.concat(lines, F.array_compact(F.array(F.when(header_count > 0, WORDING["headers"]))))
    lines = F.when(calm, F.array(F.lit("No significant threats detected."))).when(F.size(lines) == 0, F.array(F.lit(WORDING["general"]))).otherwise(lines)
    shown = F.concat_ws("; ", F.transform(F.slice(top_evidence, 1, policy.max_reasons), lambda e: F.concat(e["category"], F.lit(":"), e["feature"], F.lit("="), e["value"])))
    rest = F.array_compact(F.array(
        F.when(F.size(top_evidence) > 0, F.concat(F.lit("Top evidence: "), shown)),
        F.when(~calm, F.format_string("Component agreement %.2f, disagreement %.2f.", agreement, disagree)),
        F.when(level == "REVIEW", F.format_string("For review: risk %.2f is high and so is the uncertainty, %.2f.", probability, uncertainty)),
    ))
    kept = F.slice(F.concat(lines, rest), 1, policy.max_reasons + 3)
    return F.concat_ws("\n", F.transform(kept, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)))


def mailbox_action(level: Column) -> Column:
    """Struct of what is done with a message of a level: action, flag to set, whether it is moved."""
    return F.struct(
        F.when(level == "BLOCK", "quarantine").when(level == "REVIEW", "mark").when(level == "FLAG", "mark").otherwise("none").alias("action"),
        F.when(level == "REVIEW", "$Suspicious").when(level == "FLAG", "$Phishing").alias("flag"),
        (level == "BLOCK").alias("moved"),
    )
