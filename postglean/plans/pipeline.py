"""The scoring plan: detectors add one struct column each, fusion turns them into verdicts."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.once import once
from ..functions.robust import clamp
from ..functions.text import TACTICS, normalize_text, phrase_probability, tactic, text_or_empty, token_set
from ..functions.urls import suspicion
from ..operators import attachments, consistency, evidence, fusion, headers, history, intent, markup
from ..policy import Policy
from ..session import stored

Detector = Callable[[DataFrame, Policy], DataFrame]
EMPTY_STRINGS = "array<string>"


def prepared(messages: DataFrame) -> DataFrame:
    """``messages`` with the normalised body, tactics and header features that several detectors share.

    Null lists read as empty, null texts as ''. Each Python function runs once: its result is a column from here on.
    """
    rows = messages.withColumns({
        "urls": F.coalesce("urls", F.expr("cast(array() as array<struct<raw_url:string,normalized:string,domain:string,tld:string,is_punycode:boolean,display_text_mismatch:boolean,display_text:string,scheme:string>>)")),
        "attachments": F.coalesce("attachments", F.expr("cast(array() as array<struct<filename:string,content_type:string,size:bigint,has_macros:boolean>>)")),
    })
    rows = once(rows, normalized_body=normalize_text(F.coalesce(F.nullif("visible_text", F.lit("")), "body_plain")), _folded_domain=F.lower(normalize_text(headers.clean_domain(F.col("from_addr")))))
    auth = headers.auth_failures(F.col("headers"))
    rules = headers.header_anomalies(F.col("from_addr"), F.col("return_path"), F.col("reply_to"), F.col("from_display"))
    rows = once(rows, _count=headers.anomaly_count(auth, rules), _text=phrase_probability(F.col("normalized_body")), **{f"_tactic_{n}": tactic(F.col("normalized_body"), n) for n, _, _ in TACTICS})
    return once(rows, score=fusion.raw_score(F.col("_text"), F.col("_count")), _words=token_set(F.coalesce(F.nullif("visible_text", F.lit("")), "body_plain")), _head=token_set(F.col("subject")))


def _evidence(rows: DataFrame, name: str, items: list[tuple]) -> DataFrame:
    """``rows`` with ``_e_<name>``: the evidence of the ``items`` (condition, category, feature, value, score, module, and perhaps severity and confidence) that hold."""
    made = []
    for holds, category, feature, value, score, module, *more in items:
        sev, confidence = (F.lit(more[0]), more[1]) if more else (None, "medium")
        made.append(F.when(holds, evidence.item(category, feature, value, score, module, sev, confidence)))
    return once(rows, **{f"_e_{name}": F.array_compact(F.array(*made))})


def _said(pattern: str, *columns):
    return F.format_string(pattern, *columns)


HTML_SCORES = ("html_risk_score", "form_risk_score", "obfuscation_score", "external_resource_score")


def detect_html(rows: DataFrame, policy: Policy) -> DataFrame:
    has = text_or_empty(F.col("body_html")) != ""
    rows = rows.withColumn("_m", markup.measures("body_html", headers.clean_domain(F.col("from_addr"))))
    rows = once(rows, _js=markup.script_features(F.col("_m")))
    m, js = F.col("_m"), F.col("_js")
    context = F.lit(0.0)
    if policy.html_context:
        failed = F.greatest(*[F.coalesce(F.col(f"{k}_result") == "fail", F.lit(False)) for k in ("spf", "dkim", "dmarc")])
        given = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("sender_reputation", "domain_reputation") if c in rows.columns]
        context = markup.context_risk(F.greatest(F.lit(0.0), F.lit(0.0), *given), failed, F.lit(0.0))
    scores = markup.html_scores(m, js, context)
    rows = once(rows, **{n: F.when(has, scores[n]) for n in HTML_SCORES}, _failed_html=F.coalesce(m["degraded"], F.lit(False)))
    steal, outer, secret = (m[c] for c in ("credential_collection_indicator_count", "form_external_action_count", "password_form_count"))
    hidden, styles, code, tokens = m["hidden_text_length"], m["suspicious_style_attributes"], js["encoded_javascript_indicators"], js["suspicious_javascript_tokens"]
    moved, sent = m["transparent_element_count"] + m["offscreen_element_count"], m["meta_refresh_count"] + m["js_redirect_count"]
    least = lambda x: F.least(x, F.lit(1.0))
    rows = _evidence(rows, "html", [
        (has & (steal > 0), "HTML", "password_form_external_action", _said("%d form(s)", steal), F.lit(0.9), "html.forms", "critical", "high"),
        (has & (steal == 0) & (outer > 0), "HTML", "external_form_action", _said("%d form(s)", outer), F.lit(0.5), "html.forms"),
        (has & (steal == 0) & (outer == 0) & (secret > 0), "HTML", "password_form", _said("%d form(s)", secret), F.lit(0.6), "html.forms"),
        (has & (hidden >= 10), "HTML", "hidden_text", _said("%d chars", hidden), least(0.5 + hidden / 400), "html.obfuscation"),
        (has & (styles > 0), "HTML", "css_obfuscation", _said("%d style(s)", styles), least(0.2 + 0.1 * styles), "html.obfuscation"),
        (has & (moved > 0), "HTML", "hidden_positioning", _said("%d element(s)", moved), F.lit(0.5), "html.obfuscation"),
        (has & (sent > 0), "HTML", "suspicious_redirect", _said("%d", sent), F.lit(0.5), "html.obfuscation"),
        (has & (code > 0), "HTML", "encoded_javascript", _said("%d indicator(s)", code), least(0.4 + 0.1 * code), "html.javascript"),
        (has & (tokens > 0), "HTML", "suspicious_js_tokens", _said("%d token(s)", tokens), least(0.2 + 0.15 * tokens), "html.javascript"),
        (has & (js["javascript_entropy"] >= 5), "HTML", "js_entropy", _said("%.2f", js["javascript_entropy"]), least(js["javascript_entropy"] / 8), "html.javascript"),
        (has & (F.col("external_resource_score") >= 0.5), "HTML", "external_resources", _said("%d resource(s)", m["external_resource_count"]), F.col("external_resource_score"), "html"),
    ])
    return rows.drop("_m", "_js")


def detect_attachments(rows: DataFrame, policy: Policy) -> DataFrame:
    """Names, declared types and macro flags of the listed files; payloads are inspected by their own operator, whose
    evidence is taken where the rows bring it as ``attachment_evidence`` (``attachments.file_evidence``)."""
    risk = attachments.listed_risk(F.col("attachments"))
    rows = once(rows, attachment_filename_risk=risk).withColumn("attachment_risk_score", F.when(F.size("attachments") > 0, F.col("attachment_filename_risk") if policy.fix_attachment_risk else F.lit(0.0)))
    if "attachment_evidence" in rows.columns:
        return rows.withColumn("_e_attachment", F.coalesce("attachment_evidence", F.array()))
    one = lambda a: attachments.listed_evidence(a["filename"], a["has_macros"])
    return once(rows, _e_attachment=F.array_distinct(F.flatten(F.transform("attachments", one))))


def detect_consistency(rows: DataFrame, policy: Policy) -> DataFrame:
    base = consistency.identity_base(F.col("from_display"), F.col("subject"), F.col("from_addr"), F.col("reply_to"))
    rows = once(rows, **{f"_i_{n}": c for n, c in base.items()})
    visual, other = consistency.claimed_brands(policy, F.col("_i_sender"), F.col("_i_text"), F.col("_folded_domain"))
    rows = once(rows, _i_visual=visual, _i_other=other)
    a = consistency.identity_scores(policy, *[F.col(f"_i_{n}") for n in ("sender", "reply", "shown", "visual", "other")])
    b = consistency.link_features(F.col("urls"), F.col("extracted_image_text"), F.col("extracted_qr_urls"), F.col("visible_text"))
    c = consistency.semantic_features(F.col("_head"), F.col("_words"), F.col("urls"), F.col("attachments"))
    made = {**a, **b, **c}
    rows = once(rows, **{n: made[n] for n in (*consistency.FEATURES, "attachment_filename_mime_mismatch")}, **{f"_x_{n}": made[n] for n in ("display_domain", "claimed_brand", "links_shown", "image_domain", "code_domain")})
    f, sender = F.col, F.col("_i_sender")
    claim = _said("claims %s from %s", f("_x_claimed_brand"), sender)
    wrong = F.round(f("display_domain_mismatch") * f("_x_links_shown")).cast("int")
    items = [
        (f("sender_identity_mismatch") >= 0.8, "CONSISTENCY", "sender_identity_mismatch", _said("%s vs %s", f("_x_display_domain"), sender), F.lit(0.8), "consistency.identity"),
        (f("brand_visual_domain_mismatch") > 0, "CONSISTENCY", "brand_visual_domain_mismatch", claim, F.lit(0.9), "consistency.identity", "critical", "high"),
        ((f("brand_domain_mismatch") > 0) & (f("brand_visual_domain_mismatch") == 0), "CONSISTENCY", "brand_domain_mismatch", claim, F.lit(0.6), "consistency.identity"),
        (f("replyto_identity_mismatch") >= 0.5, "CONSISTENCY", "replyto_identity_mismatch", _said("reply-to %s", f("_i_reply")), F.lit(0.7), "consistency.identity"),
        (f("identity_history_mismatch") >= 0.5, "CONSISTENCY", "identity_history_mismatch", F.lit("name not used by this sender before"), F.lit(0.6), "consistency.identity"),
        (f("display_domain_mismatch") >= 0.5, "CONSISTENCY", "display_href_mismatch", _said("%d/%d links", wrong, f("_x_links_shown")), F.lit(0.9), "consistency.link", "critical", "high"),
        (f("ocr_url_mismatch") >= 0.8, "CONSISTENCY", "ocr_url_mismatch", f("_x_image_domain"), F.lit(0.8), "consistency.link"),
        (f("qr_context_mismatch") > 0, "CONSISTENCY", "qr_context_mismatch", _said("QR -> %s", f("_x_code_domain")), F.lit(0.7), "consistency.link"),
    ]
    items += [(f(n) >= 0.6, "CONSISTENCY", n, _said("%.2f", f(n)), f(n), "consistency.semantic") for n in ("text_url_semantic_mismatch", "subject_body_mismatch", "attachment_context_mismatch", "attachment_filename_mime_mismatch")]
    against, overall = consistency.contradiction({n: f(n) for n in consistency.FEATURES})
    return once(_evidence(rows, "consistency", items), contradiction_score=against, overall_consistency=overall)


def _values(names: tuple[str, ...], category: str, module: str, least: float) -> list[tuple]:
    return [(F.col(n) >= least, category, n, _said("%.2f", F.col(n)), F.col(n), module) for n in names]


def detect_intent(rows: DataFrame, policy: Policy) -> DataFrame:
    """Reads the columns of the consistency detector where there are any."""
    t = intent.tactics(F.col("normalized_body"), F.size("urls") > 0, F.size("attachments") > 0, F.coalesce(F.size("extracted_qr_urls"), F.lit(0)) > 0)
    failed = F.greatest(*[(F.col(f"{k}_result") == "fail").cast("double") for k in ("spf", "dkim", "dmarc")])
    one = lambda c: F.col(c) if c in rows.columns else F.lit(0.0)
    brand, reply = F.greatest(one("brand_domain_mismatch"), one("brand_visual_domain_mismatch")), one("replyto_identity_mismatch")
    rows = once(rows, **{f"_t_{n}": v for n, v in t.items()}, _suspicion=suspicion(F.col("urls")), _files=attachments.listed_risk(F.col("attachments")))
    own = {n: F.col(f"_t_{n}") for n in intent.TACTIC_NAMES}
    made = intent.intents(own, F.col("_suspicion"), brand, reply, F.col("_files"), F.coalesce(failed, F.lit(0.0)))
    return _evidence(once(rows, **made), "intent", _values(intent.INTENT_NAMES, "TACTIC", "intent", 0.5))


def _teaches(probability, level, policy: Policy):
    """Whether a message teaches the history, by the policy; before its level is known its probability stands in."""
    if policy.learn_from == "always":
        return F.lit(True)
    if policy.learn_from == "confirmed_only":
        return level == "ALLOW" if level is not None else probability < policy.flag
    return level != "BLOCK" if level is not None else probability < policy.block


def detect_behaviour(rows: DataFrame, policy: Policy) -> DataFrame:
    """History features against the messages of ``rows`` themselves; those that may be blocked teach nothing.

    A level depends on history, so row by row only the probability is known: certain and uncertain risk above the
    threshold alike teach nothing here. :func:`learn`, which has the levels, follows them exactly.
    """
    obs = stored(history.observations(rows.withColumn("learnable", _teaches(fusion.calibrate(F.col("score")), None, policy))), "observations")
    scores = stored(history.behaviour(obs).select("msg_id", *history.FEATURES), "history")
    rows = rows.join(scores.hint("merge"), "msg_id", "left")
    return _evidence(rows, "behavioral", _values(history.FEATURES, "BEHAVIOR", "behavioral", 0.35))


def _zero(*names: str) -> Detector:
    return lambda rows, policy: rows.withColumns({n: F.lit(0.0) for n in names})


@dataclass
class Registry:
    """Detectors in order; registering a name again replaces it at the end.

    A detector takes rows and policy and adds columns, its evidence as ``_e_<name>``. ``fallbacks`` stand in for
    one whose plan can't be made; without one its columns are missing. ``hooks`` are called by :func:`learn`. A detector
    whose Python function fails on a row marks it in ``_failed_<name>``.
    """

    detectors: dict[str, Detector] = field(default_factory=dict)
    fallbacks: dict[str, Detector] = field(default_factory=dict)
    hooks: dict[str, Callable[[DataFrame], None]] = field(default_factory=dict)
    #: Of the last run: error of the detectors that failed, milliseconds that the making of each plan took.
    failed: dict[str, str] = field(default_factory=dict)
    plan_ms: dict[str, float] = field(default_factory=dict)

    def register(self, name: str, detector: Detector, fallback: Detector | None = None, hook: Callable[[DataFrame], None] | None = None) -> Registry:
        self.unregister(name)
        self.detectors[name] = detector
        if fallback:
            self.fallbacks[name] = fallback
        if hook:
            self.hooks[name] = hook
        return self

    def unregister(self, name: str) -> Registry:
        for kept in (self.detectors, self.fallbacks, self.hooks):
            kept.pop(name, None)
        return self

    def apply(self, rows: DataFrame, policy: Policy) -> DataFrame:
        """All detectors in turn, each isolated: one that fails is replaced by its fallback and named in ``failed``."""
        self.failed, self.plan_ms = {}, {}
        for name, detector in self.detectors.items():
            began = time.perf_counter()
            try:
                made = detector(rows, policy)
                made.schema  # analysis errors belong to the detector
                rows = made
            except Exception as e:  # isolation: no detector may end the plan
                self.failed[name] = f"{type(e).__name__}: {e}"
                warnings.warn(f"detector {name} failed: {self.failed[name][:200]}", stacklevel=2)
                if name in self.fallbacks:
                    rows = self.fallbacks[name](rows, policy)
            self.plan_ms[name] = round((time.perf_counter() - began) * 1000, 3)
        return rows


def default_registry(with_history: bool = True) -> Registry:
    r = Registry()
    r.register("html", detect_html, _zero(*HTML_SCORES)).register("attachment", detect_attachments).register("consistency", detect_consistency).register("intent", detect_intent)
    return r.register("behavioral", detect_behaviour, _zero(*history.FEATURES)) if with_history else r


def _max_of(rows: DataFrame, names: tuple[str, ...]):
    own = [n for n in names if n in rows.columns]
    return F.greatest(*own, F.lit(None).cast("double")) if own else F.lit(None).cast("double")


#: Keys of the component scores: prefix and columns.
SCORE_KEYS = (
    ("html.", HTML_SCORES), ("attachment.", ("attachment_filename_risk", "attachment_risk_score")), ("consistency.", (*consistency.FEATURES, "attachment_filename_mime_mismatch")),
    ("intent.", intent.INTENT_NAMES), ("behavioral.", history.FEATURES),
)


def score(messages: DataFrame, policy: Policy | None = None, registry: Registry | None = None) -> DataFrame:
    """One verdict per message: ``msg_id, mailbox, uid, score, calibrated_probability, uncertainty, confidence,
    component_agreement, component_disagreement, level, reasons, evidence, explanation, action, component_scores, degraded``.

    ``degraded`` names the detectors that failed as a whole or on this row. ``msg_id`` must be unique where history takes
    part. An empty table gives no rows; extra columns are ignored.
    """
    policy, registry = policy or Policy(), registry or default_registry()
    rows = registry.apply(prepared(messages), policy)
    one = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("double")
    parts = {
        "text": F.col("_text"), "headers": F.col("_count") / 6, "html": one("html_risk_score"), "attachment": one("attachment_risk_score"),
        "consistency": _max_of(rows, consistency.FEATURES), "intent": _max_of(rows, intent.INTENT_NAMES), "behavioral": _max_of(rows, history.FEATURES),
    }
    present = sum((F.when(parts[c].isNotNull(), 1).otherwise(0) if c in parts else F.lit(0) for c in fusion.COMPONENTS), F.lit(0))
    rows = once(rows, calibrated_probability=fusion.calibrate(F.col("score")), _missing=len(fusion.COMPONENTS) - present, _risks=F.array_compact(F.array(*[clamp(v) for v in parts.values()])))
    rows = once(rows, _d=fusion.disagreement(F.col("_risks")))
    rows = once(rows, **fusion.uncertainty_report(F.col("_d"), F.col("_missing"), F.col("calibrated_probability")))
    found = [F.coalesce(F.col(f"_e_{n}"), F.array()) for n in registry.detectors if f"_e_{n}" in rows.columns]
    phrase = F.array_compact(F.array(F.when(F.col("_text") >= 0.6, evidence.item("TEXT", "phrase", _said("%.2f", F.col("_text")), F.col("_text"), "text"))))
    pairs = [(n, F.col(c)) for n, c in (("text", "_text"), ("headers_anomaly_count", "_count"), *((f"tactic.{n}", f"_tactic_{n}") for n, _, _ in TACTICS))]
    pairs += [(prefix + n, F.col(n)) for prefix, names in SCORE_KEYS for n in names if n in rows.columns]
    pairs += [(f"intent.tactic.{n}", F.col(f"_t_{n}")) for n in intent.TACTIC_NAMES if f"_t_{n}" in rows.columns]
    scores = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n), c.cast("double").alias("v")) for n, c in pairs]), lambda x: x["v"].isNotNull()))
    marks = [F.when(F.col(c), c.removeprefix("_failed_")) for c in rows.columns if c.startswith("_failed_")] + [F.lit(n) for n in registry.failed]
    rows = once(
        rows, level=fusion.decide(F.col("calibrated_probability"), F.col("uncertainty"), policy), evidence=evidence.ranked(F.concat(phrase, *found)), component_scores=scores,
        degraded=F.array_compact(F.array(*marks, F.lit(None).cast("string"))), reasons=fusion.reasons({n: F.col(f"_tactic_{n}") for n, _, _ in TACTICS}, policy.reason_threshold),
    )
    told = fusion.explain(F.col("level"), F.col("reasons"), F.col("_count"), F.col("evidence"), F.col("component_agreement"), F.col("component_disagreement"), F.col("calibrated_probability"), F.col("uncertainty"), policy)
    return rows.select(
        "msg_id", "mailbox", "uid", "score", F.round("calibrated_probability", 4).alias("calibrated_probability"), "uncertainty", "confidence", "component_agreement", "component_disagreement",
        "level", "reasons", "evidence", told.alias("explanation"), fusion.mailbox_action(F.col("level")).alias("action"), "component_scores", "degraded",
    )


#: The eleven sub-registries of the ablation: name and the detectors that take part ("" is text and headers alone).
ABLATION = (
    ("A", ()), ("B", ("html",)), ("C", ("attachment",)), ("D", ("consistency",)), ("E", ("intent",)), ("F", ("behavioral",)), ("G", ("html", "attachment")), ("H", ("html", "attachment", "consistency")),
    ("I", ("html", "attachment", "consistency", "intent")), ("J", ("attachment", "consistency", "intent", "behavioral")), ("K", ("html", "attachment", "consistency", "intent", "behavioral")),
)


def ablation(messages: DataFrame, policy: Policy | None = None, names: tuple[str, ...] = tuple(n for n, _ in ABLATION)) -> DataFrame:
    """``configuration, msg_id, level, calibrated_probability, uncertainty`` under each sub-registry."""
    whole = default_registry().detectors
    runs = []
    for name, kept in ABLATION:
        if name in names:
            made = score(messages, policy, Registry({n: d for n, d in whole.items() if n in kept}))
            runs.append(made.select(F.lit(name).alias("configuration"), "msg_id", "level", "calibrated_probability", "uncertainty"))
    return reduce(DataFrame.unionByName, runs)


def learn(past: DataFrame | None, messages: DataFrame, verdicts: DataFrame, policy: Policy | None = None, registry: Registry | None = None) -> DataFrame:
    """``past`` observations with those of ``messages`` whose verdict lets them teach; each (mailbox, uid) once."""
    policy = policy or Policy()
    v = verdicts.select("msg_id", "level")
    kept = messages.join(v.hint("merge"), "msg_id").where(_teaches(None, F.col("level"), policy)).drop("level")
    for hook in (registry.hooks if registry else {}).values():
        hook(kept)
    new = history.observations(kept).dropDuplicates(["mailbox", "uid"])
    if past is None:
        return new
    return past.unionByName(new.join(past.select("mailbox", "uid"), ["mailbox", "uid"], "left_anti"))
