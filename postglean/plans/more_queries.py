"""Further queries of the message-risk operators: profiles, identity, store, evaluation, graph, velocity; each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import blocks, robust, text as tx, urls as ul
from ..operators import attachments as att, campaigns, consistency as con, evaluation as ev, evidence as evd, graph, headers as hd, history, intent as it, profiles
from ..policy import Policy
from ..sources import store
from ..sources.tables import table
from ..streaming import velocity
from . import pipeline
from .risk_sql import _DOM, _DOMAIN, _HOST, _LAB, _MAIL, _TAC, _B, _U, _any, _tokens
from ..functions.text import LINK_STOPWORDS, STOPWORDS
from ..operators.attachments import DANGEROUS, DECOY_EXTENSIONS
from ..operators.intent import ATTACHMENT_MARKS, GIFT_MARKS, LINK_MARKS, PASSWORD_MARKS

Query = Callable[[SparkSession, str], DataFrame]
SQL: dict[str, str] = {}
QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _m(s, d):
    return table(s, d, "messages")


# Links ----------------------------------------------------------------------------------------------------------------
_LOOKS = r"regexp_matches({0}, '(?i)^(https?://|www\.)') OR regexp_matches({0}, '(?i)^[a-z0-9-]+(\.[a-z0-9-]+)+$')"


@query("url08_looks_like_url", f"SELECT msg_id, pos, ({_LOOKS.format('t')}) AS looks FROM (SELECT msg_id, pos, trim(coalesce(u.display_text, '')) AS t FROM ({_U}))")
def url08(s, d):
    return _m(s, d).select("msg_id", F.posexplode("urls").alias("pos", "u")).select("msg_id", F.col("pos").cast("bigint").alias("pos"), ul.looks_like_url(F.col("u.display_text")).alias("looks"))


@query("url09_external", f"""WITH x AS (SELECT msg_id, pos, u.raw_url AS r, {_HOST.format('u.raw_url')} AS h, {_DOM.format('from_addr')} AS s FROM (SELECT msg_id, from_addr, unnest(urls) AS u, generate_subscripts(urls, 1) - 1 AS pos FROM messages))
SELECT msg_id, pos, h <> '' AND NOT starts_with(lower(trim(r)), 'data:') AND (s = '' OR NOT (h = s OR ends_with(h, '.' || s))) AS external FROM x""")  # fmt: skip
def url09(s, d):
    u = _m(s, d).select("msg_id", hd.clean_domain(F.col("from_addr")).alias("s"), F.posexplode("urls").alias("pos", "u"))
    return u.select("msg_id", F.col("pos").cast("bigint").alias("pos"), ul.is_external(F.col("u.raw_url"), F.col("s")).alias("external"))


@query("url12_in_feeds", f"WITH l AS (SELECT msg_id, pos, lower(u.domain) AS domain FROM ({_U})) SELECT msg_id, pos, domain FROM l WHERE domain <> '' AND domain IN (SELECT domain FROM l WHERE msg_id % 50 = 0)")
def url12(s, d):
    """The feed is made of the link domains of every fiftieth message."""
    links = _m(s, d).select("msg_id", F.posexplode("urls").alias("pos", "u")).select("msg_id", F.col("pos").cast("bigint").alias("pos"), F.lower("u.domain").alias("domain")).where("domain <> ''")
    return ul.in_feeds(links, links.where("msg_id % 50 = 0"))


# Identity -------------------------------------------------------------------------------------------------------------
def _below(x: str, domains) -> str:
    return "(" + " OR ".join(f"{x} = '{v}' OR ends_with({x}, '.{v}')" for v in domains) + ")"


def _identity_sql() -> str:
    p = Policy()
    text = "lower(coalesce(from_display, '') || ' ' || coalesce(subject, ''))"
    parts = []
    for key, (name, domains) in p.brands.items():
        near = " OR ".join(f"levenshtein(s, '{v}') <= 2 OR contains(s, '{v.split('.')[0]}')" for v in domains)
        parts.append(f"SELECT msg_id, '{name}' AS brand, {len(parts)} AS k, (contains(t, '{key}') OR contains(t, '{name.lower()}')) AND NOT {_below('s', domains)} AND NOT {_below('s', p.mailing_domains)} AS claimed, s <> '' AND NOT {_below('s', domains)} AND ({near}) AS alike FROM b")
    own = tuple(v for _, vs in p.brands.values() for v in vs)
    return f"""WITH b AS (SELECT msg_id, {text} AS t, {_DOM.format('from_addr')} AS s, {_DOM.format('reply_to')} AS r, lower(regexp_extract(coalesce(from_display, ''), '{_DOMAIN}', 1)) AS shown FROM messages),
c AS ({' UNION ALL '.join(parts)}),
g AS (SELECT msg_id, coalesce(bool_or(claimed AND alike), false) AS visual, coalesce(bool_or(claimed AND NOT alike), false) AS other, coalesce(arg_min(brand, k) FILTER (WHERE claimed AND alike), arg_min(brand, k) FILTER (WHERE claimed)) AS brand FROM c GROUP BY 1)
SELECT msg_id, CASE WHEN shown <> '' AND s <> '' AND shown <> s THEN 0.8 WHEN other THEN 0.5 ELSE 0 END::DOUBLE AS sender_identity_mismatch,
 CASE WHEN r = '' OR s = '' OR r = s THEN 0 WHEN {_below('r', own)} THEN 0.2 WHEN {_below('r', p.mailing_domains)} THEN 0.15 ELSE 0.7 END::DOUBLE AS replyto_identity_mismatch,
 CASE WHEN visual THEN 0.9 WHEN other THEN 0.6 ELSE 0 END::DOUBLE AS brand_domain_mismatch, CASE WHEN visual THEN 0.9 ELSE 0 END::DOUBLE AS brand_visual_domain_mismatch, brand AS claimed_brand, shown AS display_domain
FROM b JOIN g USING (msg_id)"""


@query("con08_identity", _identity_sql())
def con08(s, d):
    f = con.identity_features(Policy(), F.col("from_display"), F.col("subject"), F.col("from_addr"), F.col("reply_to"), F.lower(hd.clean_domain(F.col("from_addr"))))
    return _m(s, d).select("msg_id", *[f[n].alias(n) for n in ("sender_identity_mismatch", "replyto_identity_mismatch", "brand_domain_mismatch", "brand_visual_domain_mismatch", "claimed_brand", "display_domain")])


_BRANDED = tuple(v for _, vs in Policy().brands.values() for v in vs)


@query("con02_edit_distance", f"""WITH x AS (SELECT DISTINCT msg_id, lower(u.domain) AS domain FROM ({_U}) WHERE u.domain <> '' UNION SELECT msg_id, {_DOM.format('from_addr')} FROM messages)
SELECT msg_id, domain, of, levenshtein(domain, of) AS distance FROM x CROSS JOIN (VALUES {', '.join(f"('{v}')" for v in (*_BRANDED, 'velmora.example', 'orvane.example', 'halden.example'))}) t(of) WHERE domain <> '' AND levenshtein(domain, of) <= 4""")  # fmt: skip
def con02(s, d):
    """Every link and sender domain of every message against the protected domains (a fixed list) and three of the mail store."""
    m = _m(s, d)
    domains = m.select("msg_id", F.explode("urls").alias("u")).select("msg_id", F.lower("u.domain").alias("domain")).unionByName(m.select("msg_id", hd.clean_domain(F.col("from_addr")).alias("domain")))
    of = F.explode(F.array(*[F.lit(v) for v in (*_BRANDED, "velmora.example", "orvane.example", "halden.example")]))
    rows = domains.where("domain <> ''").distinct().select("msg_id", "domain", of.alias("of"))
    return rows.select("*", F.levenshtein("domain", "of", 4).cast("bigint").alias("distance")).where("distance between 0 and 4")


def _contained(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 THEN 1 WHEN len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / len({a}) END"


@query("con11_semantic", f"""WITH b AS (SELECT msg_id, list_distinct({_tokens('subject', LINK_STOPWORDS)}) AS h, list_distinct({_tokens('visible_text', LINK_STOPWORDS)}) AS w, coalesce(urls, []) AS us, coalesce(attachments, []) AS fs FROM messages),
u AS (SELECT msg_id, w, unnest(us) AS u FROM b), x AS (SELECT msg_id, w, list_distinct(list_concat({_tokens("regexp_replace(coalesce(u.domain, ''), '[.-]', ' ', 'g')", LINK_STOPWORDS)}, {_tokens('u.normalized', LINK_STOPWORDS)})) AS l FROM u), lu AS (SELECT msg_id, max({_contained('l', 'w')}) AS best FROM x GROUP BY 1),
f AS (SELECT msg_id, w, unnest(fs) AS f FROM b), y AS (SELECT msg_id, w, list_distinct({_tokens('f.filename', LINK_STOPWORDS)}) AS l FROM f), lf AS (SELECT msg_id, max({_contained('l', 'w')}) AS best FROM y GROUP BY 1)
SELECT b.msg_id, round(CASE WHEN len(w) > 0 AND len(us) > 0 THEN greatest(0, least(1, 0.7::DOUBLE - lu.best)) ELSE 0 END, 6)::DOUBLE AS text_url_semantic_mismatch, round(CASE WHEN len(w) > 0 AND len(h) > 0 THEN greatest(0, least(1, 0.8::DOUBLE - {_contained('h', 'w')})) ELSE 0 END, 6)::DOUBLE AS subject_body_mismatch,
 round(CASE WHEN len(w) > 0 AND len(fs) > 0 THEN greatest(0, least(1, 0.7::DOUBLE - lf.best)) ELSE 0 END, 6)::DOUBLE AS attachment_context_mismatch FROM b LEFT JOIN lu USING (msg_id) LEFT JOIN lf USING (msg_id)""")  # fmt: skip
def con11(s, d):
    f = con.semantic_features(tx.token_set(F.col("subject")), tx.token_set(F.col("visible_text")), F.col("urls"), F.col("attachments"))
    return _m(s, d).select("msg_id", *[F.round(f[n], 6).alias(n) for n in ("text_url_semantic_mismatch", "subject_body_mismatch", "attachment_context_mismatch")])


_KINDS = ", ".join(f"('{e}', {list(p)})" for e, p in con.EXTENSION_TYPES.items())


@query("con11_declared_types", f"""WITH a AS (SELECT msg_id, unnest(attachments) AS a, generate_subscripts(attachments, 1) - 1 AS pos FROM messages), x AS (SELECT msg_id, pos, CASE WHEN contains(coalesce(a.filename, ''), '.') THEN lower(string_split(a.filename, '.')[-1]) ELSE '' END AS e, lower(coalesce(a.content_type, '')) AS t FROM a)
SELECT msg_id, pos, CASE WHEN t <> '' AND k.e IS NOT NULL AND len(list_filter(k.p, lambda v: contains(t, v))) = 0 THEN 0.6 ELSE 0 END::DOUBLE AS mismatch FROM x LEFT JOIN (VALUES {_KINDS}) k(e, p) ON k.e = x.e""")  # fmt: skip
def con11t(s, d):
    a = _m(s, d).select("msg_id", F.posexplode("attachments").alias("pos", "a"))
    return a.select("msg_id", F.col("pos").cast("bigint").alias("pos"), con.declared_type_mismatch(F.col("a.filename"), F.col("a.content_type")).alias("mismatch"))


_FRISK = f"""CASE WHEN trim(coalesce(a.filename, '')) = '' THEN 0 ELSE greatest(CASE WHEN len(string_split(trim(a.filename), '.')) > 1 AND lower(string_split(trim(a.filename), '.')[-1]) IN {tuple(DANGEROUS)} THEN 0.9 ELSE 0 END,
 CASE WHEN len(string_split(trim(a.filename), '.')) >= 3 AND lower(string_split(trim(a.filename), '.')[-1]) IN {tuple(DANGEROUS)} AND lower(string_split(trim(a.filename), '.')[-2]) IN {tuple(DECOY_EXTENSIONS)} THEN 0.8 ELSE 0 END, CASE WHEN regexp_matches(a.filename, '[\\x{{202A}}\\x{{202D}}\\x{{202E}}\\x{{200F}}]') THEN 1.0 ELSE 0 END, CASE WHEN length(trim(a.filename)) > 120 THEN 0.3 ELSE 0 END) END"""


@query("att13_listed_risk", f"WITH a AS (SELECT msg_id, unnest(attachments) AS a FROM messages), r AS (SELECT msg_id, max(greatest({_FRISK}, CASE WHEN a.has_macros THEN 0.8 ELSE 0 END)) AS r FROM a GROUP BY 1) SELECT m.msg_id, coalesce(r, 0)::DOUBLE AS risk FROM messages m LEFT JOIN r USING (msg_id)")
def att13(s, d):
    return _m(s, d).select("msg_id", att.listed_risk(F.col("attachments")).alias("risk"))


_CLAMP = "greatest(0, least(1, {0}))::DOUBLE"
_INTENT = f"""WITH i AS ({_identity_sql()}), t0 AS (SELECT msg_id, {_TAC}, len(coalesce(urls, [])) > 0 AS hu, len(coalesce(attachments, [])) > 0 AS ha, len(coalesce(extracted_qr_urls, [])) > 0 AS hq, {_any(_B, LINK_MARKS)} AS lm, {_any(_B, ATTACHMENT_MARKS)} AS am, {_any(_B, GIFT_MARKS)} AS gm, {_any(_B, PASSWORD_MARKS)} AS pm,
 (coalesce(spf_result, '') = 'fail' OR coalesce(dkim_result, '') = 'fail' OR coalesce(dmarc_result, '') = 'fail')::INT::DOUBLE AS fail FROM messages),
t AS (SELECT msg_id, urgency::DOUBLE AS u, authority::DOUBLE AS a, greatest(credential_request, CASE WHEN pm THEN 0.5 ELSE 0 END)::DOUBLE AS c, greatest(financial, CASE WHEN gm THEN 0.7 ELSE 0 END)::DOUBLE AS p,
 greatest(CASE WHEN hu AND lm THEN 0.6 WHEN hu AND (urgency > 0 OR credential_request > 0 OR pm) THEN 0.4 ELSE 0 END, CASE WHEN hq THEN 0.5 ELSE 0 END)::DOUBLE AS lb, CASE WHEN ha OR am THEN 0.6 ELSE 0 END::DOUBLE AS al, fail FROM t0),
f AS (SELECT msg_id, max(greatest({_FRISK}, CASE WHEN a.has_macros THEN 0.8 ELSE 0 END))::DOUBLE AS fr FROM (SELECT msg_id, unnest(attachments) AS a FROM messages) GROUP BY 1),
x AS (SELECT t.*, coalesce(fr, 0) AS fr, greatest(brand_domain_mismatch, brand_visual_domain_mismatch) AS b, replyto_identity_mismatch AS rp FROM t JOIN i USING (msg_id) LEFT JOIN f USING (msg_id))
"""


@query("int03_intents", _INTENT + f"SELECT msg_id, round({_CLAMP.format('p * greatest(0.4::DOUBLE, a, rp, 0.9::DOUBLE * u)')}, 6) AS financial_fraud_score, round({_CLAMP.format('c * greatest(b, fail, 0.3::DOUBLE)')}, 6) AS account_takeover_score, round({_CLAMP.format('a * p * (0.6::DOUBLE + 0.4::DOUBLE * rp)')}, 6) AS business_email_compromise_score, round({_CLAMP.format('al * greatest(fr, 0.3::DOUBLE)')}, 6) AS malicious_attachment_score, round({_CLAMP.format('greatest(u, a) * (0.5::DOUBLE + 0.5::DOUBLE * greatest(lb, al))')}, 6) AS social_engineering_score FROM x")
def int03(s, d):
    """The derived scores of all messages over the plain body, from the tactics, identity, listed files and failed checks."""
    m = _m(s, d)
    t = it.tactics(F.col("body_plain"), F.coalesce(F.size("urls") > 0, F.lit(False)), F.coalesce(F.size("attachments") > 0, F.lit(False)), F.coalesce(F.size("extracted_qr_urls") > 0, F.lit(False)))
    i = con.identity_features(Policy(), F.col("from_display"), F.col("subject"), F.col("from_addr"), F.col("reply_to"), F.lower(hd.clean_domain(F.col("from_addr"))))
    fail = F.coalesce(F.greatest(*[(F.coalesce(F.col(f"{k}_result"), F.lit("")) == "fail").cast("double") for k in ("spf", "dkim", "dmarc")]), F.lit(0.0))
    made = it.intents(t, ul.suspicion(F.col("urls")), F.greatest(i["brand_domain_mismatch"], i["brand_visual_domain_mismatch"]), i["replyto_identity_mismatch"], att.listed_risk(F.col("attachments")), fail)
    return m.select("msg_id", *[F.round(made[n], 6).alias(n) for n in it.INTENT_NAMES[1:]])


# History and profiles -------------------------------------------------------------------------------------------------
_OBS = f"""WITH o AS (SELECT msg_id, uid, ingested_at AS t_at, lower(coalesce(from_addr, '')) AS sender, lower(coalesce(recipients[1], '')) AS recipient, {_DOM.format('from_addr')} AS domain, {_DOM.format('reply_to')} AS reply_domain, lower(trim(coalesce(from_display, ''))) AS display,
 length(coalesce(visible_text, ''))::DOUBLE AS length, coalesce(len(urls), 0)::DOUBLE AS n_urls, coalesce(len(attachments), 0) AS n_files, (coalesce(spf_result, '') = 'fail' OR coalesce(dkim_result, '') = 'fail' OR coalesce(dmarc_result, '') = 'fail') AS failed, subject, urls, attachments FROM messages)
"""
_OVER = "OVER (PARTITION BY {0} ORDER BY t_at, uid, msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_NOV = "CASE WHEN coalesce({1}, 0) <= 0 OR coalesce({0}, 0) <= 0 THEN 1 ELSE greatest(1 - {0} / {1}, 0) END"


def _counted(name: str, keys: str, what: str = "*") -> str:
    return f"coalesce({'count(*)' if what == '*' else f'count(*) FILTER (WHERE {what})'} {_OVER.format(keys)}, 0) AS {name}"


@query("beh01_shares", _OBS + f""", c AS (SELECT *, {_counted('n', 'sender')}, {_counted('nd', 'sender, domain')}, {_counted('nn', 'sender, display')}, {_counted('named', 'sender', "display <> ''")}, {_counted('nr', 'sender, reply_domain')}, {_counted('replied', 'sender', "reply_domain <> ''")}, {_counted('nf', 'sender', 'failed')}, {_counted('pn', 'sender, recipient')} FROM o)
SELECT msg_id, round(CASE WHEN n > 0 THEN 1 / (1 + n / 5.0) ELSE 1 END, 6)::DOUBLE AS sender_newness_score, round(CASE WHEN n > 0 AND domain <> '' THEN {_NOV.format('nd', 'n')} ELSE 0 END, 6)::DOUBLE AS sender_domain_change_score,
 round(CASE WHEN reply_domain = '' THEN 0 ELSE greatest(CASE WHEN n > 0 THEN {_NOV.format('nr', 'replied')} ELSE 0 END, CASE WHEN reply_domain <> domain THEN 0.6 ELSE 0 END) END, 6)::DOUBLE AS sender_replyto_anomaly, round(CASE WHEN n > 0 AND failed THEN 1 - nf / n ELSE 0 END, 6)::DOUBLE AS sender_authentication_anomaly,
 round(CASE WHEN pn > 0 THEN 1 / (1 + pn / 3.0) ELSE 1 END, 6)::DOUBLE AS recipient_relationship_newness, round(CASE WHEN n > 0 AND display <> '' THEN {_NOV.format('nn', 'named')} ELSE 0 END, 6)::DOUBLE AS display_name_history_anomaly FROM c""")  # fmt: skip
def beh01(s, d):
    names = ("sender_newness_score", "sender_domain_change_score", "sender_replyto_anomaly", "sender_authentication_anomaly", "recipient_relationship_newness", "display_name_history_anomaly")
    return history.behaviour(history.observations(_m(s, d))).select("msg_id", *[F.round(n, 6).alias(n) for n in names])


@query("agg07_time_anomaly", _MAIL + """, h AS (SELECT mailbox, uid, hour(t_at) + minute(t_at) / 60.0 AS h, isodow(t_at) - 1 AS d FROM m), g AS (SELECT mailbox, uid, abs(h - 13) % 24 AS a, abs(d - 2) AS b FROM h)
SELECT mailbox, uid, round(least(least(a, 24 - a) / 12.0, 1), 6)::DOUBLE AS hour_anomaly, round(least(least(b, 7 - b) / 3.0, 1), 6)::DOUBLE AS weekday_anomaly FROM g""")  # fmt: skip
def agg07(s, d):
    """Of every email against a usual hour of 13 and a usual Wednesday."""
    from .risk_queries import _mail

    m = _mail(s, d)
    return m.select("mailbox", "uid", F.round(robust.hour_anomaly(F.hour("at") + F.minute("at") / 60.0, F.lit(13.0)), 6).alias("hour_anomaly"), F.round(robust.weekday_anomaly(F.weekday("at"), F.lit(2)), 6).alias("weekday_anomaly"))


def _two_folds(s, d, keys):
    """All messages folded in two steps, as they would be from day to day; the second one starts where the first ended."""
    obs = history.observations(_m(s, d))
    middle = obs.agg(F.percentile_approx("at", 0.5).alias("t"))  # one row
    marked = obs.crossJoin(F.broadcast(middle)).withColumn("late", F.coalesce(F.col("at") > F.col("t"), F.lit(False))).drop("t")
    first = profiles.fold(None, marked.where("not late").drop("late"), keys)
    return profiles.fold(first, marked.where("late").drop("late"), keys)


_SEEN = _OBS + f""", c AS (SELECT *, {_counted('n', 'sender')}, {_counted('shown', 'sender, display')} FROM o)
"""


@query("agg11_profile_totals", _SEEN + """SELECT sender, count(*) AS messages, count(*) FILTER (WHERE n_files > 0) AS file_messages, count(*) FILTER (WHERE display <> '' AND n > 0) AS display_total, count(*) FILTER (WHERE display <> '' AND n > 0 AND shown > 0) AS display_ok, min(t_at) AS first_seen, max(t_at) AS last_seen FROM c GROUP BY 1""")
def agg11(s, d):
    return _two_folds(s, d, profiles.SENDER).totals.select("sender", *[F.col(c).cast("bigint").alias(c) for c in ("messages", "file_messages", "display_total", "display_ok")], "first_seen", "last_seen")


@query("agg10_counters", _OBS + f""", k AS (SELECT sender, 'recipient' AS kind, recipient AS value FROM o UNION ALL SELECT sender, 'recipient_domain', regexp_extract(recipient, '@([^@]+)$', 1) FROM o UNION ALL SELECT sender, 'sender_domain', domain FROM o UNION ALL SELECT sender, 'reply_domain', reply_domain FROM o
UNION ALL SELECT sender, 'display', display FROM o UNION ALL SELECT sender, 'auth', CASE WHEN failed THEN 'fail' ELSE 'pass' END FROM o UNION ALL SELECT sender, 'word', unnest(list_distinct({_tokens('subject', STOPWORDS)})) FROM o
UNION ALL SELECT sender, 'url_domain', unnest(list_distinct(list_transform(urls, lambda u: coalesce(u.domain, '')))) FROM o UNION ALL SELECT sender, 'file_type', unnest(list_distinct(list_transform(attachments, lambda a: coalesce(a.content_type, '')))) FROM o),
g AS (SELECT sender, kind, value, count(*) AS n FROM k WHERE value <> '' GROUP BY ALL) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY sender, kind ORDER BY n DESC, value) <= 200""")  # fmt: skip
def agg10(s, d):
    """Counters after one fold; a counter cut at 200 keys after each of several folds may keep other rare keys."""
    return profiles.fold(None, history.observations(_m(s, d))).counters


@query("agg12_derived_profile", _OBS + """, r AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY sender ORDER BY t_at DESC, uid DESC, msg_id DESC) <= 500), s AS (SELECT sender, median(length) AS lm, mad(length) AS lmad, median(n_urls) AS um FROM r GROUP BY 1),
g AS (SELECT sender, count(*) AS n, count(*) FILTER (WHERE n_files > 0) AS f, min(t_at) AS a, max(t_at) AS b FROM o GROUP BY 1), dn AS (SELECT sender, display, count(*) AS k FROM o WHERE display <> '' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY sender ORDER BY count(*) DESC, display) = 1)
SELECT sender, n AS messages, round(lm, 6) AS length_median, round(lmad, 6) AS length_mad, round(um, 6) AS n_urls_median, round(n / greatest((epoch_us(b) - epoch_us(a)) / 86400e6, 1 / 24), 4) AS per_day, round(f / n, 6) AS file_share, round(1 / (1 + n / 5.0), 6)::DOUBLE AS newness, display FROM g JOIN s USING (sender) LEFT JOIN dn USING (sender)""")  # fmt: skip
def agg12(s, d):
    p = profiles.derived(_two_folds(s, d, profiles.SENDER))
    return p.select("sender", F.col("messages").cast("bigint").alias("messages"), *[F.round(c, 6).alias(c) for c in ("length_median", "length_mad", "n_urls_median")], F.round("per_day", 4).alias("per_day"), F.round("file_share", 6).alias("file_share"), F.round("newness", 6).alias("newness"), "display")


_PAST = "msg_id % 2 = 0"


@query("jon04_profile_lookup", _OBS + f""", a AS (SELECT * FROM o WHERE {_PAST}), p AS (SELECT sender, count(*) AS messages FROM a WHERE sender <> '' GROUP BY 1), dn AS (SELECT sender, display, count(*) AS k FROM a WHERE display <> '' AND sender <> '' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY sender ORDER BY count(*) DESC, display) = 1),
f AS (SELECT display, arg_max(struct_pack(s := sender, m := messages), struct_pack(m := messages, s := sender)) AS f FROM dn JOIN p USING (sender) GROUP BY 1), pr AS (SELECT sender, recipient, count(*) AS pair_messages FROM a WHERE recipient <> '' GROUP BY 1, 2),
l AS (SELECT o.msg_id, o.recipient, CASE WHEN p.messages IS NOT NULL THEN o.sender ELSE f.f.s END AS profile_sender, coalesce(p.messages, f.f.m) AS messages FROM o LEFT JOIN p USING (sender) LEFT JOIN f USING (display))
SELECT msg_id, profile_sender, messages, pair_messages FROM l LEFT JOIN pr ON pr.sender = profile_sender AND pr.recipient = l.recipient""")  # fmt: skip
def jon04(s, d):
    """All messages against the profiles of those with an even id, by sender, else by display name, and the pair."""
    m = _m(s, d)
    past = history.observations(m.where(_PAST))
    got = profiles.lookup(m, profiles.derived(profiles.fold(None, past)), profiles.fold(None, past, profiles.PAIR).totals)
    return got.select("msg_id", "profile_sender", F.col("messages").cast("bigint").alias("messages"), F.col("pair_messages").cast("bigint").alias("pair_messages"))


_WINDOWS = ", ".join(f"sum(n) OVER (PARTITION BY {{0}} ORDER BY h RANGE BETWEEN {h - 1} PRECEDING AND CURRENT ROW) AS {{1}}_{h}h" for h in velocity.HOURS)


def _velocity_sql() -> str:
    out = "WITH b AS (SELECT msg_id, floor(epoch_us(ingested_at) / 3600000000)::BIGINT AS h, lower(coalesce(from_addr, '')) AS sender, lower(coalesce(recipients[1], '')) AS recipient, lower(coalesce(urls[1].domain, '')) AS domain FROM messages)"
    for name, keys in velocity.KEYS.items():
        k = ", ".join(keys)
        filled = " AND ".join(f"{x} <> ''" for x in keys)
        out += f", c_{name} AS (SELECT {k}, h, count(*) AS n FROM b WHERE {filled} AND h IS NOT NULL GROUP BY ALL), v_{name} AS (SELECT {k}, h, {_WINDOWS.format(k, name)} FROM c_{name})"
    columns = ", ".join(f"coalesce({n}_{h}h, 0)::BIGINT AS {n}_{h}h" for n in velocity.KEYS for h in velocity.HOURS)
    return out + f" SELECT msg_id, {columns} FROM b " + " ".join(f"LEFT JOIN v_{n} USING ({', '.join(keys)}, h)" for n, keys in velocity.KEYS.items())


@query("str07_velocity", _velocity_sql())
def str07(s, d):
    v = velocity.velocities(_m(s, d))
    return v.select("msg_id", *[F.col(c).cast("bigint").alias(c) for c in v.columns if c != "msg_id"])


# Store ----------------------------------------------------------------------------------------------------------------
def _scored(s, d):
    """Verdict rows in the shape of scored messages."""
    from ..operators import fusion

    v = store.latest(table(s, d, "verdicts").where("verdict is not null"), ["mailbox", "uid"], ["created_at"])
    level = F.upper(F.trim("verdict"))
    return v.select("mailbox", "uid", "score", level.alias("level"), F.coalesce(F.from_json("reasons_json", "array<string>"), F.array().cast("array<string>")).alias("reasons"), fusion.mailbox_action(level).alias("action"), F.create_map(F.lit("headers_anomaly_count"), F.lit(2)).alias("component_scores"), "created_at")


_LAST = "WITH v AS (SELECT mailbox, uid, score, upper(trim(verdict)) AS level, coalesce(TRY_CAST(TRY_CAST(reasons_json AS JSON) AS VARCHAR[]), []) AS reasons, created_at FROM verdicts WHERE verdict IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mailbox, uid ORDER BY created_at DESC NULLS LAST, score DESC NULLS LAST, verdict DESC) = 1) "


@query("snk02_verdict_rows", _LAST + """SELECT mailbox, uid, score, level AS verdict, '[' || list_aggregate(list_transform(reasons, lambda r: '"' || r || '"'), 'string_agg', ',') || ']' AS reasons_json, '{"headers_anomaly_count":2}' AS component_scores_json, created_at FROM v WHERE len(reasons) > 0""")
def snk02(s, d):
    return store.verdicts_table(_scored(s, d).where(F.size("reasons") > 0), F.col("created_at"))


@query("snk03_audit_rows", _LAST + """SELECT mailbox, uid, CASE WHEN level = 'BLOCK' THEN 'quarantine' ELSE 'mark' END AS action_taken, 'level ' || level || '; ' || coalesce(list_aggregate(reasons, 'string_agg', '; '), '') AS reason, created_at AS logged_at FROM v WHERE level IN ('BLOCK', 'REVIEW', 'FLAG')""")
def snk03(s, d):
    return store.audit_rows(_scored(s, d), F.col("created_at"))


@query("snk05_migrated_audit", "SELECT coalesce((SELECT min(mailbox) FROM emails e WHERE e.uid = a.uid), '') AS mailbox, uid, action_taken, reason, logged_at FROM audit_log a")
def snk05(s, d):
    """The audit log of the older layout, without mailbox and with a column too many, in the present one."""
    return store.migrated(table(s, d, "audit_log").drop("mailbox").withColumn("old", F.lit(1)), "audit_log", table(s, d, "emails"))


@query("snk07_tracking_events", 'SELECT mailbox, uid, action_taken AS event, logged_at AS "at" FROM audit_log')
def snk07(s, d):
    a = table(s, d, "audit_log")
    return store.migrated(a.select("mailbox", "uid", F.col("action_taken").alias("event"), F.col("logged_at").alias("at")), "test_events")


@query("snk10_mark_read", "SELECT msg_id::VARCHAR AS id, from_addr AS sender, msg_id % 3 = 0 AS read FROM messages")
def snk10(s, d):
    box = _m(s, d).select(F.col("msg_id").cast("string").alias("id"), F.col("from_addr").alias("sender"), F.lit(False).alias("read"))
    return store.mark_read(box, box.where("cast(id as bigint) % 3 = 0"))


@query("agg16_baselines", "SELECT mailbox, coalesce(max(uid), 0) AS last_uid FROM emails GROUP BY 1")
def agg16(s, d):
    return store.offsets(table(s, d, "emails"))


@query("agg16_baseline_unknown", "SELECT 0::BIGINT AS last_uid")
def agg16u(s, d):
    return store.baseline(table(s, d, "emails"), "nobody@nowhere.test")


@query("top02_inbox", 'SELECT msg_id::VARCHAR AS id, lower(recipients[1]) AS recipient, ingested_at AS "at" FROM messages WHERE lower(recipients[1]) = (SELECT min(lower(recipients[1])) FROM messages) ORDER BY ingested_at DESC, id DESC LIMIT 10')
def top02(s, d):
    box = _m(s, d).select(F.col("msg_id").cast("string").alias("id"), F.lower(F.try_element_at("recipients", F.lit(1))).alias("recipient"), F.col("ingested_at").alias("at"))
    return store.inbox(box, box.agg(F.min("recipient")).first()[0] or "", 10)


@query("top03_users", "SELECT lower(from_addr) AS email, max(from_display) AS name, min(ingested_at) AS created_at FROM messages WHERE from_addr <> '' GROUP BY 1")
def top03(s, d):
    u = _m(s, d).where("from_addr <> ''").groupBy(F.lower("from_addr").alias("email")).agg(F.max("from_display").alias("name"), F.min("ingested_at").alias("created_at"), F.lit("x").alias("password_hash"))
    return store.users(u)


@query("top04_latest_match", "SELECT mailbox, max(uid) AS uid, arg_max(subject, struct_pack(uid := uid, subject := subject)) AS subject FROM emails WHERE contains(subject, 'the') AND uid > 10 GROUP BY 1")
def top04(s, d):
    return store.latest_match(table(s, d, "emails"), "the", 10)


# Evidence, evaluation, graph ------------------------------------------------------------------------------------------
@query("evd01_items", """WITH s AS (SELECT DISTINCT score FROM verdicts), i AS (SELECT score, greatest(0, least(1, score * 1.2::DOUBLE - 0.1::DOUBLE)) AS n FROM s WHERE score IS NOT NULL)
SELECT score, round(n, 6) AS normalized_score, CASE WHEN n >= 0.9 THEN 'critical' WHEN n >= 0.7 THEN 'high' WHEN n >= 0.4 THEN 'medium' WHEN n > 0 THEN 'low' ELSE 'info' END AS severity, substr(sha1('TEXT|f|v|m'), 1, 16) AS evidence_id, 'f' AS explanation_key, 'medium' AS confidence FROM i""")  # fmt: skip
def evd01(s, d):
    v = table(s, d, "verdicts").where("score is not null").select("score").distinct().withColumn("e", evd.item("TEXT", "f", F.lit("v"), F.col("score") * 1.2 - 0.1, "m"))
    return v.select("score", F.round("e.normalized_score", 6).alias("normalized_score"), "e.severity", "e.evidence_id", "e.explanation_key", "e.confidence")


def _labelled(s, d):
    v = table(s, d, "verdicts").where("verdict is not null")
    return v.select("score", F.upper(F.trim("verdict")).isin("BLOCK", "REVIEW").cast("int").alias("label"))


@query("spc07_cheapest_threshold", _LAB + ", k AS (SELECT *, tp + fp AS blocked, first_value(tp + fp) OVER (ORDER BY bin ROWS BETWEEN 150 PRECEDING AND CURRENT ROW) - tp - fp AS reviewed FROM c) SELECT bin / 1000 AS threshold, tp, fp, fn, tn, blocked, reviewed, fp * 1.0 + fn * 10.0 + blocked * 2.0 + reviewed * 0.5 AS cost FROM k ORDER BY cost, threshold LIMIT 1")
def spc07(s, d):
    return ev.cheapest(ev.curve(_labelled(s, d))).select("threshold", "tp", "fp", "fn", "tn", "blocked", "reviewed", "cost")


@query("spc08_areas", _LAB + """, r AS (SELECT bin, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS y, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS x, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p FROM c), z AS (SELECT *, lag(x, 1, 0) OVER (ORDER BY bin DESC) AS lx, lag(y, 1, 0) OVER (ORDER BY bin DESC) AS ly FROM r)
SELECT round(sum((x - lx) * (y + ly) / 2), 6) AS roc_auc, round(sum((y - ly) * p), 6) AS pr_auc, round(min(x) FILTER (WHERE y >= 0.95), 6) AS fpr_at_95 FROM z""")  # fmt: skip
def spc08(s, d):
    return ev.area(ev.curve(_labelled(s, d)))


@query("spc12_isotonic", """WITH l AS (SELECT floor(least(greatest(score, 0), 1) * 1000)::INT AS bin, (upper(trim(verdict)) IN ('BLOCK', 'REVIEW'))::INT AS y FROM verdicts WHERE verdict IS NOT NULL AND score IS NOT NULL), g AS (SELECT bin, count(*) AS n, sum(y) AS y FROM l GROUP BY 1),
s AS (SELECT a.bin AS a, b.bin AS b, (SELECT sum(y) / sum(n) FROM g WHERE g.bin BETWEEN a.bin AND b.bin) AS m FROM g a JOIN g b ON a.bin <= b.bin), lo AS (SELECT a, b, min(m) OVER (PARTITION BY a ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS m FROM s)
SELECT g.bin, g.n, round(g.y / g.n, 6) AS rate, round(max(lo.m), 6) AS calibrated FROM g JOIN lo ON lo.b = g.bin GROUP BY g.bin, g.n, g.y""")  # fmt: skip
def spc12(s, d):
    return ev.isotonic(_labelled(s, d)).select("bin", "n", F.round("rate", 6).alias("rate"), F.round("calibrated", 6).alias("calibrated"))


_PART = "CASE WHEN u < 0.8::DOUBLE THEN 'train' WHEN u < 0.8::DOUBLE + 0.1::DOUBLE THEN 'valid' ELSE 'test' END"


@query("spc06_leakage", f"""WITH s AS (SELECT sha1(text) AS fingerprint, ('0x' || substr(sha1(coalesce(thread_key, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM documents), p AS (SELECT fingerprint, {_PART} AS part FROM s)
SELECT fingerprint, string_agg(DISTINCT part, ',' ORDER BY part) AS parts, count(*) AS n FROM p GROUP BY 1 HAVING count(DISTINCT part) > 1""")  # fmt: skip
def spc06(s, d):
    """A split of the documents by thread, and the texts that stand in several parts all the same."""
    r = ev.split(table(s, d, "documents"), "thread_key")
    return ev.leakage(r, F.sha1("text")).select("fingerprint", F.concat_ws(",", "parts").alias("parts"), "n")


@query("spc04_infrastructure", """WITH u AS (SELECT msg_id, ingested_at, unnest(urls) AS u FROM messages), l AS (SELECT 'domain:' || lower(u.domain) AS domain, msg_id, min(ingested_at) AS t FROM u WHERE u.normalized IS NOT NULL AND u.domain <> '' GROUP BY 1, 2),
j AS (SELECT msg_id, (coalesce(spf_result, '') = 'fail')::INT AS bad FROM messages), h AS (SELECT domain, date_trunc('hour', t) AS hour, count(*) AS n, sum(bad) AS bad FROM l JOIN j USING (msg_id) GROUP BY 1, 2)
SELECT domain, sum(n)::BIGINT AS messages, count(*) AS hours, round(max(n) / sum(n), 6) AS burstiness, round((sum(bad) + (SELECT avg(bad) FROM j)) / (sum(n) + 1), 6) AS neighbour_reputation FROM h GROUP BY 1""")  # fmt: skip
def spc04(s, d):
    m = _m(s, d)
    judged = m.select(F.concat(F.lit("message:"), F.col("msg_id").cast("string")).alias("message"), F.coalesce((F.col("spf_result") == "fail").cast("int"), F.lit(0)).alias("bad"))
    r = graph.infrastructure(graph.edges(m), judged)
    return r.select("domain", "messages", "hours", F.round("burstiness", 6).alias("burstiness"), F.round("neighbour_reputation", 6).alias("neighbour_reputation"))


@query("spc05_communities")
def spc05(s, d):
    return graph.communities(graph.edges(_m(s, d)).where("type = 'SENT'")).select("id", "label")


_SUBJECT = "trim(regexp_replace(lower(coalesce(subject, '')), '^(?:\\s*(?:re|aw|fwd?|wg)\\s*:)+|\\d+|\\s+', ' ', 'g'))"
_SIGNALS = f"""WITH g AS (SELECT DISTINCT msg_id, 'domain' AS channel, lower(coalesce(u.domain, '')) AS value FROM ({_U}) UNION SELECT DISTINCT msg_id, 'file', concat_ws('/', lower(a.filename), a.content_type) FROM (SELECT msg_id, unnest(attachments) AS a FROM messages)
UNION SELECT msg_id, 'subject', {_SUBJECT} FROM messages UNION SELECT msg_id, 'sender', lower(regexp_extract(coalesce(from_addr, ''), '@([^@>\\s]+)', 1)) FROM messages),
t AS (SELECT channel, value, count(*) AS messages, CASE channel WHEN 'domain' THEN 0.35 WHEN 'file' THEN 0.35 WHEN 'subject' THEN 0.2 ELSE 0.1 END::DOUBLE AS weight, count(*) >= 3 AS promoted FROM g WHERE value <> '' GROUP BY 1, 2 HAVING count(*) > 1) """


@query("spc02_campaigns", _SIGNALS + "SELECT * FROM t")
def spc02(s, d):
    return campaigns.campaign_table(campaigns.signals(_m(s, d)))


@query("spc01_campaign_members", _SIGNALS + ", h AS (SELECT msg_id, channel, max(weight) AS w FROM g JOIN t USING (channel, value) WHERE promoted GROUP BY 1, 2) SELECT msg_id, count(*) AS channels, round(sum(w), 6) AS score FROM h GROUP BY 1 HAVING count(*) >= 2")
def spc01(s, d):
    r = campaigns.signals(_m(s, d))
    return campaigns.membership(r, campaigns.campaign_table(r))


@query("spc01_text_channels", f"""WITH b AS (SELECT msg_id, list_distinct({_tokens("coalesce(nullif(visible_text, ''), body_plain)", LINK_STOPWORDS)}) AS x FROM messages),
h AS (SELECT msg_id, list_transform(range(8), lambda k: list_min(list_transform(x, lambda w: md5(k || ':' || w)))) AS h FROM b WHERE len(x) > 0)
SELECT msg_id, 'words' AS channel, k || ':' || md5(h[2 * k + 1] || h[2 * k + 2]) AS value FROM h CROSS JOIN (SELECT unnest(range(4)) AS k)""")  # fmt: skip
def spc01t(s, d):
    return campaigns.text_signals(_m(s, d)).where("channel = 'words'")


@query("spc01_all_channels")
def spc01a(s, d):
    m = _m(s, d)
    r = campaigns.signals(m).unionByName(campaigns.text_signals(m))
    return campaigns.membership(r, campaigns.campaign_table(r))


@query("spc10_ablation")
def spc10(s, d):
    r = pipeline.ablation(_m(s, d), names=("A", "B", "H", "I"))
    return r.groupBy("configuration", "level").agg(F.count("*").alias("messages"), F.round(F.avg("uncertainty"), 6).alias("mean_uncertainty"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
