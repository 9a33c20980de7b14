"""DuckDB SQL for the message-risk queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from ..functions.text import CONFUSABLES, LINK_STOPWORDS, STOPWORDS
from ..functions.urls import RISKY_TLDS
from ..operators.attachments import DANGEROUS, DECOY_EXTENSIONS
from ..operators.intent import ATTACHMENT_MARKS, GIFT_MARKS, LINK_MARKS, PASSWORD_MARKS


def _list(xs) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"


def _any(x: str, marks) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m}')" for m in marks) + ")"


def _tokens(x: str, stop) -> str:
    return f"list_filter(list_transform(string_split_regex(replace(lower(coalesce({x}, '')), '_', ' '), '[\\s\\x{{0085}}\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda p: regexp_replace(p, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda w: length(w) > 2 AND w NOT IN {_list(stop)})"



def _r(x: str, n: int) -> str:
    """Rounding of the number's shortest decimal form, half up, as Spark does it."""
    return f"round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(30, 18)), {n})::DOUBLE"


_FOLD = f"replace(replace(translate(s, '{''.join(CONFUSABLES)}', '{''.join(CONFUSABLES.values())}'), 'æ', 'ae'), 'œ', 'oe')"
_DOMAIN = r"(?i)\b([a-z0-9-]+(?:\.[a-z0-9-]+)+)\b"
_B = "lower(coalesce(body_plain, ''))"
_DOM = "lower(regexp_replace(CASE WHEN contains(coalesce({0}, ''), '@') THEN string_split({0}, '@')[-1] ELSE '' END, '[<> ]', '', 'g'))"
_RAW = "(CASE WHEN contains(coalesce({0}, ''), '@') THEN string_split({0}, '@')[-1] ELSE '' END)"
_U = "SELECT msg_id, unnest(urls) AS u, generate_subscripts(urls, 1) - 1 AS pos FROM messages"
_HOST = r"lower(regexp_extract(coalesce({0}, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_ADDR = r"""CASE WHEN regexp_matches(sender, '<\s*(mailto:)?[^<>\s@]+@[^<>\s@]+\s*>\s*$') THEN regexp_extract(sender, '<\s*(?:mailto:)?([^<>\s@]+@[^<>\s@]+)\s*>\s*$', 1)
    ELSE nullif(regexp_extract(regexp_replace(sender, '"[^"]*"|\([^()]*\)|^\s*(?i:mailto):', ' ', 'g'), '([^\s<>()\[\],;:@"]+@[^\s<>()\[\],;:@"]+)', 1), '') END"""
_MAIL = f"""WITH a AS (SELECT mailbox, uid, received_at, subject, lower({_ADDR}) AS sender FROM emails WHERE received_at IS NOT NULL),
m AS (SELECT mailbox, uid, max(sender) AS sender, max(received_at) AS t_at, max(length(coalesce(subject, '')))::DOUBLE AS len FROM a WHERE sender IS NOT NULL GROUP BY 1, 2) """
_PAST = "PARTITION BY sender ORDER BY t_at, mailbox, uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_REC = "PARTITION BY sender ORDER BY t_at, mailbox, uid ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING"
_SEV = "CASE WHEN score >= 0.9 THEN 'critical' WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'info' END"
_ITEMS = f"""WITH r AS (SELECT mailbox, uid, created_at, score, unnest(TRY_CAST(TRY_CAST(reasons_json AS JSON) AS VARCHAR[])) AS feature FROM verdicts WHERE score IS NOT NULL),
i AS (SELECT *, upper(string_split(feature, '.')[1]) AS category, {_SEV} AS severity, substr(sha1(upper(string_split(feature, '.')[1]) || '|' || feature || '||stored'), 1, 16) AS evidence_id,
 {_r(f"score * (CASE {_SEV} WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.25 ELSE 0 END)::DOUBLE", 6)} AS rank_score, epoch_us(created_at) AS seq FROM r),
d AS (SELECT *, min(seq) OVER (PARTITION BY mailbox, uid, evidence_id) AS first, row_number() OVER (PARTITION BY mailbox, uid, evidence_id ORDER BY rank_score DESC, seq) AS k FROM i) """
_BACK, _REPLY, _FROM = _RAW.format("return_path"), _RAW.format("reply_to"), _RAW.format("from_addr")
_AUTH = "lower(coalesce(element_at(headers, 'Authentication-Results')[1], ''))"
_Z = "CASE WHEN abs(coalesce(mad, 0)) <= 1e-9 THEN greatest(abs(med) * 0.1, 1e-6) ELSE mad END"
_EDGES = """WITH raw AS (SELECT lower(coalesce(from_addr, '')) AS src, lower(unnest(list_distinct(list_concat(coalesce(recipients, []), coalesce(cc, []))))) AS dst, 'SENT' AS type, ingested_at AS t_at FROM messages
UNION ALL SELECT 'message:' || msg_id, 'url:' || u.normalized, 'CONTAINS', ingested_at FROM (SELECT msg_id, ingested_at, unnest(urls) AS u FROM messages)
UNION ALL SELECT 'url:' || u.normalized, 'domain:' || lower(u.domain), 'HOSTED_ON', ingested_at FROM (SELECT ingested_at, unnest(urls) AS u FROM messages) WHERE u.domain <> ''), e AS (SELECT * FROM raw WHERE src <> '' AND dst <> '') """
_LAB = """WITH l AS (SELECT floor(least(greatest(score, 0), 1) * 1000)::INT AS bin, (upper(trim(verdict)) IN ('BLOCK', 'REVIEW'))::INT AS y FROM verdicts WHERE verdict IS NOT NULL AND score IS NOT NULL),
c AS (SELECT t.k AS bin, count(*) FILTER (WHERE y = 1 AND l.bin >= t.k) AS tp, count(*) FILTER (WHERE y = 0 AND l.bin >= t.k) AS fp, count(*) FILTER (WHERE y = 1 AND l.bin < t.k) AS fn, count(*) FILTER (WHERE y = 0 AND l.bin < t.k) AS tn FROM range(1001) t(k) CROSS JOIN l GROUP BY 1) """
_JAC = f"WITH t AS (SELECT msg_id, list_distinct({_tokens('subject', LINK_STOPWORDS)}) AS a, list_distinct({_tokens('visible_text', LINK_STOPWORDS)}) AS b FROM messages), n AS (SELECT msg_id, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS k FROM t) "
_TAC = f"""CASE WHEN {_any(_B, ('urgent', 'immediately'))} THEN 0.9 ELSE 0 END AS urgency, CASE WHEN {_any(_B, ('ceo', 'boss'))} THEN 0.8 ELSE 0 END AS authority,
 CASE WHEN {_any(_B, ('verify', 'login'))} THEN 0.95 ELSE 0 END AS credential_request, CASE WHEN {_any(_B, ('wire', 'invoice'))} THEN 0.85 ELSE 0 END AS financial"""
_X = "greatest(0, least(1, {0}))"

_TEXTS = "(SELECT msg_id, unnest(['subject', 'body_plain', 'visible_text']) AS field, unnest([coalesce(subject, ''), coalesce(body_plain, ''), coalesce(visible_text, '')]) AS s FROM messages)"

SQL = {
    "txt02_confusable_fold": f"SELECT msg_id, field, CASE WHEN regexp_matches(s, '[^\\x00-\\x7F]') THEN {_FOLD} ELSE s END AS folded FROM {_TEXTS}",
    "txt07_token_bag": f"SELECT lang, word, count(*) AS n FROM (SELECT lower(lang) AS lang, unnest({_tokens('text', STOPWORDS)}) AS word FROM documents) GROUP BY 1, 2",
    "txt08_token_set": f"SELECT msg_id, field, len(list_distinct({_tokens('s', LINK_STOPWORDS)})) AS words FROM {_TEXTS}",
    "txt10_phrase_ladder": f"SELECT msg_id, CASE WHEN contains({_B}, 'update your account') THEN 0.85 WHEN contains({_B}, 'urgent wire') THEN 0.9 WHEN contains({_B}, 'verify your identity') THEN 0.88 ELSE 0.1 END::DOUBLE AS probability FROM messages",
    "txt12_tactics": f"SELECT msg_id, urgency::DOUBLE AS urgency, authority::DOUBLE AS authority, credential_request::DOUBLE AS credential_request, financial::DOUBLE AS financial FROM (SELECT msg_id, {_TAC} FROM messages)",
    "url01_authority": f"SELECT msg_id, pos, trim(string_split(string_split(string_split(regexp_replace(u.raw_url, '^.*?://', ''), '/')[1], '?')[1], '@')[-1]) AS authority, CASE WHEN contains(u.raw_url, '://') THEN lower(string_split(u.raw_url, '://')[1]) ELSE '' END AS scheme, {_HOST.format('u.raw_url')} AS host FROM ({_U})",
    "url05_urls_in_text": r"""SELECT msg_id, url, count(*) AS n FROM (SELECT msg_id, regexp_replace(unnest(regexp_extract_all(coalesce(body_plain, ''), '(?i)h?t?t?ps?://[^\s<>"'')]+')), '[.,;)]+$', '') AS url FROM messages) GROUP BY 1, 2""",
    "url07_domain_in_text": f"SELECT msg_id, field, lower(regexp_extract(s, '{_DOMAIN}', 1)) AS domain FROM {_TEXTS}",
    "url10_suspicion": f"""SELECT m.msg_id, coalesce(s, 0)::DOUBLE AS suspicion FROM messages m LEFT JOIN (SELECT msg_id, max(greatest(CASE WHEN u.is_punycode THEN 0.8 ELSE 0 END, CASE WHEN coalesce(u.domain, '') <> '' AND u.display_text_mismatch THEN 0.7 ELSE 0 END,
 CASE WHEN contains(coalesce(u.raw_url, ''), '@') THEN 0.7 ELSE 0 END, CASE WHEN contains(lower(u.domain), '.') AND string_split(lower(u.domain), '.')[-1] IN {_list(RISKY_TLDS)} THEN 0.5 ELSE 0 END,
 CASE WHEN coalesce(u.domain, '') <> '' AND regexp_matches(string_split(lower(u.domain), '.')[1], '[0-9-]') THEN 0.4 ELSE 0 END)) AS s FROM ({_U}) GROUP BY 1) USING (msg_id)""",
    "url11_lexical": f"""WITH x AS (SELECT msg_id, pos, u.raw_url AS r, {_HOST.format('u.raw_url')} AS h FROM ({_U}))
SELECT msg_id, pos, length(r) AS url_length, round(CASE WHEN length(r) > 0 THEN length(regexp_replace(r, '[^0-9]', '', 'g')) / length(r) ELSE 0 END, 6) AS digit_ratio, greatest(len(string_split(h, '.')) - 2, 0)::BIGINT AS subdomain_depth,
 round(coalesce((SELECT -sum(p * log2(p)) FROM (SELECT count(*) / length(h) AS p FROM (SELECT unnest(string_split(h, '')) AS c) GROUP BY c)), 0), 6) AS host_entropy, string_split(h, '.')[-1] IN {_list(RISKY_TLDS)} AS risky_tld, contains(r, '@') AS has_at FROM x""",
    "htm09_text_entropy": f"WITH t AS {_TEXTS}, c AS (SELECT msg_id, field, unnest(string_split(s, '')) AS ch FROM t WHERE s <> ''), e AS (SELECT msg_id, field, entropy(ch) AS e FROM c GROUP BY 1, 2) SELECT t.msg_id, t.field, round(coalesce(e, 0), 6) AS entropy FROM t LEFT JOIN e USING (msg_id, field)",
    "hdr01_header_rules": f"""WITH f AS (SELECT msg_id, contains({_AUTH}, 'spf=fail') AS spf_fail, contains({_AUTH}, 'dkim=fail') AS dkim_fail, contains({_AUTH}, 'dmarc=fail') AS dmarc_fail,
 {_FROM} <> '' AND {_BACK} <> '' AND {_FROM} <> {_BACK} AS from_return_mismatch, {_FROM} <> '' AND {_REPLY} <> '' AND {_FROM} <> {_REPLY} AS from_reply_mismatch,
 lower(coalesce(from_display, '')) IN ('admin', 'support', 'billing') AND {_FROM} NOT IN ('google.com', 'microsoft.com', 'amazon.com', 'paypal.com') AS display_name_suspicious FROM messages)
SELECT *, (spf_fail::INT + dkim_fail::INT + dmarc_fail::INT + from_return_mismatch::INT + from_reply_mismatch::INT + display_name_suspicious::INT)::DOUBLE AS fired FROM f""",
    "con09_links": rf"""WITH b AS (SELECT msg_id, list_filter(urls, lambda u: trim(coalesce(u.display_text, '')) <> '') AS s, list_filter(list_transform(urls, lambda u: lower(coalesce(u.domain, ''))), lambda d: d <> '') AS doms,
 list_distinct(regexp_extract_all(lower(coalesce(extracted_image_text, '')), '{_DOMAIN}', 1)) AS seen, list_filter(list_transform(coalesce(extracted_qr_urls, []), lambda q: {_HOST.format('q')}), lambda h: h <> '') AS codes, lower(coalesce(visible_text, '')) AS v FROM messages)
SELECT msg_id, round(CASE WHEN len(s) > 0 THEN len(list_filter(s, lambda u: coalesce(u.display_text_mismatch, false))) / len(s) ELSE 0 END, 6) AS display_href_mismatch,
 round(CASE WHEN len(s) > 0 THEN len(list_filter(s, lambda u: lower(regexp_extract(trim(u.display_text), '{_DOMAIN}', 1)) <> '' AND coalesce(u.domain, '') <> '' AND lower(regexp_extract(trim(u.display_text), '{_DOMAIN}', 1)) <> u.domain)) / len(s) ELSE 0 END, 6) AS display_domain_mismatch,
 CASE WHEN len(seen) > 0 AND len(coalesce(doms, [])) = 0 THEN 0.5 WHEN len(seen) > 0 AND NOT list_has_any(seen, doms) THEN 0.8 ELSE 0 END::DOUBLE AS ocr_url_mismatch,
 CASE WHEN len(codes) > 0 AND len(list_filter(codes, lambda h: contains(v, h))) = 0 THEN 0.7 ELSE 0 END::DOUBLE AS qr_context_mismatch FROM b""",
    "con10_jaccard": _JAC + "SELECT msg_id, round(CASE WHEN na = 0 AND nb = 0 THEN 1 WHEN na = 0 OR nb = 0 THEN 0 ELSE k / (na + nb - k) END, 6) AS jaccard, round(CASE WHEN na = 0 THEN 1 WHEN nb = 0 THEN 0 ELSE k / na END, 6) AS containment FROM n",
    "int01_tactics": f"""WITH t AS (SELECT msg_id, {_TAC}, len(coalesce(urls, [])) > 0 AS hu, len(coalesce(attachments, [])) > 0 AS ha, len(coalesce(extracted_qr_urls, [])) > 0 AS hq, {_any(_B, LINK_MARKS)} AS lm, {_any(_B, ATTACHMENT_MARKS)} AS am, {_any(_B, GIFT_MARKS)} AS gm, {_any(_B, PASSWORD_MARKS)} AS pm FROM messages)
SELECT msg_id, urgency::DOUBLE AS urgency, authority::DOUBLE AS authority_impersonation, greatest(credential_request, CASE WHEN pm THEN 0.5 ELSE 0 END)::DOUBLE AS credential_request, greatest(financial, CASE WHEN gm THEN 0.7 ELSE 0 END)::DOUBLE AS payment_gift_card,
 greatest(CASE WHEN hu AND lm THEN 0.6 WHEN hu AND (urgency > 0 OR credential_request > 0 OR pm) THEN 0.4 ELSE 0 END, CASE WHEN hq THEN 0.5 ELSE 0 END)::DOUBLE AS link_bait, CASE WHEN ha OR am THEN 0.6 ELSE 0 END::DOUBLE AS attachment_lure FROM t""",
    "int02_derived": f"""WITH t AS (SELECT DISTINCT score, score AS u, 1 - score AS a, score * 0.5::DOUBLE AS c, least(score + 0.3::DOUBLE, 1) AS p, score * score AS lb, 0.6::DOUBLE * score AS al, 1 - score AS brand, score * 0.7::DOUBLE AS rep, CASE WHEN score > 0.5 THEN 1.0 ELSE 0 END::DOUBLE AS fail FROM verdicts)
SELECT score, {_r(_X.format('c * greatest(score, brand)'), 6)} AS credential_harvesting_score, {_r(_X.format('p * greatest(0.4::DOUBLE, a, rep, 0.9::DOUBLE * u)'), 6)} AS financial_fraud_score, {_r(_X.format('c * greatest(brand, fail, 0.3::DOUBLE)'), 6)} AS account_takeover_score,
 {_r(_X.format('a * p * (0.6::DOUBLE + 0.4::DOUBLE * rep)'), 6)} AS business_email_compromise_score, {_r(_X.format('al * greatest(score, 0.3::DOUBLE)'), 6)} AS malicious_attachment_score, {_r(_X.format('greatest(u, a) * (0.5::DOUBLE + 0.5::DOUBLE * greatest(lb, al))'), 6)} AS social_engineering_score FROM t""",
    "fus04_decide": "WITH t AS (SELECT DISTINCT score AS p, round((score * 7) % 1, 6) AS u FROM verdicts WHERE score IS NOT NULL) SELECT p, u, CASE WHEN p >= 0.85 AND u >= 0.45 THEN 'REVIEW' WHEN p >= 0.85 THEN 'BLOCK' WHEN p >= 0.7 AND u >= 0.45 THEN 'REVIEW' WHEN p >= 0.5 THEN 'FLAG' ELSE 'ALLOW' END AS level FROM t",
    "fus06_uncertainty": f"""WITH v AS (SELECT DISTINCT score AS p FROM verdicts WHERE score IS NOT NULL), r AS (SELECT p, p * 0.5::DOUBLE AS h, (0::DOUBLE + p + 0 + (1 - p) + p * 0.5::DOUBLE) / 4 AS c FROM v),
d0 AS (SELECT p, least(1, 2 * ((0::DOUBLE + abs(p - c) + abs(0 - c) + abs(1 - p - c) + abs(h - c)) / 4)) AS d, least(1, abs(p - 0.5::DOUBLE) * 2) AS m FROM r),
u0 AS (SELECT *, {_X.format('0.7::DOUBLE * d + 0.2::DOUBLE * 4 / 8 + 0.1::DOUBLE * (1 - m)')} AS u FROM d0)
SELECT p, {_r('d', 5)} AS d, {_r(_r('u', 4), 3)} AS uncertainty, {_r(_r(_X.format('greatest(p, 1 - p) * (1 - 0.5::DOUBLE * u)'), 4), 3)} AS confidence, {_r(_r('m', 4), 3)} AS margin, {_r(_r('1 - d', 4), 3)} AS component_agreement, {_r(_r('d', 4), 3)} AS component_disagreement FROM u0""",
    "evd03_evidence_id": _ITEMS + "SELECT DISTINCT category, feature, evidence_id FROM i",
    "evd04_rank": _ITEMS + "SELECT mailbox, uid, feature, severity, rank_score, count(*) AS n FROM i GROUP BY ALL",
    "evd05_dedupe": _ITEMS + "SELECT mailbox, uid, evidence_id, rank_score, first AS seq FROM d WHERE k = 1",
    "evd06_by_category": _ITEMS + "SELECT mailbox, category, count(*) AS items, round(max(score), 6) AS max_score FROM i GROUP BY 1, 2",
    "top01_evidence_topk": _ITEMS + "SELECT mailbox, uid, position, feature, rank_score FROM (SELECT *, row_number() OVER (PARTITION BY mailbox, uid ORDER BY rank_score DESC, score DESC, feature, evidence_id) AS position FROM d WHERE k = 1) WHERE position <= 3",
    "agg01_running_median_mad_z": _MAIL + f", w AS (SELECT *, coalesce(median(len) OVER ({_REC}), 0) AS med, coalesce(mad(len) OVER ({_REC}), 0) AS mad FROM m) SELECT mailbox, uid, round(med, 6) AS med, round(mad, 6) AS mad, round(least(1, abs(0.6745 * (len - med) / ({_Z})) / 3.5), 6) AS z_score FROM w",
    "agg05_novelty": _MAIL + f", w AS (SELECT *, count(*) OVER ({_PAST}) AS n, count(*) OVER ({_PAST.replace('BY sender', 'BY sender, mailbox', 1)}) AS k FROM m) SELECT mailbox, uid, round(CASE WHEN n = 0 OR k = 0 THEN 1 ELSE 1 - k / n END, 6) AS novelty, round(CASE WHEN n > 0 THEN 1 / (1 + n / 5.0) ELSE 1 END, 6) AS newness FROM w",
    "agg06_circular_hour": _MAIL + ", h AS (SELECT sender, (hour(t_at) + minute(t_at) / 60.0) * pi() / 12 AS a FROM m) SELECT sender, count(*) AS n, round(((atan2(sum(sin(a)), sum(cos(a))) * 12 / pi()) % 24 + 24) % 24, 4) AS usual_hour FROM h GROUP BY 1",
    "agg08_usual_weekday": _MAIL + ", c AS (SELECT sender, isodow(t_at) - 1 AS day, count(*) AS n FROM m GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY sender) AS total, row_number() OVER (PARTITION BY sender ORDER BY n DESC, day) AS k FROM c) SELECT sender, CASE WHEN n / total >= 0.5 THEN day END AS usual_day FROM t WHERE k = 1",
    "agg13_relationship": _MAIL + ", g AS (SELECT sender, mailbox, (epoch_us(t_at) - epoch_us(lag(t_at) OVER (PARTITION BY sender, mailbox ORDER BY t_at, uid))) / 1e6 AS gap FROM m) SELECT sender, mailbox, count(*) AS n, round(median(gap), 3) AS median_interval, round(1 / (1 + count(*) / 3.0), 6) AS newness FROM g GROUP BY 1, 2",
    "agg14_per_day": _MAIL + "SELECT sender, count(*) AS n, round(count(*) / greatest((epoch_us(max(t_at)) - epoch_us(min(t_at))) / 86400e6, 1 / 24), 4) AS per_day FROM m GROUP BY 1",
    "agg15_verdict_counts": "SELECT mailbox, upper(trim(verdict)) AS verdict, count(*) AS n FROM verdicts GROUP BY 1, 2",
    "beh02_burst": _MAIL + f", g AS (SELECT *, (epoch_us(t_at) - epoch_us(max(t_at) OVER ({_PAST}))) / 1e6 AS gap FROM m), w AS (SELECT *, median(gap) OVER ({_REC}) AS med, mad(gap) OVER ({_REC}) AS mad FROM g) SELECT mailbox, uid, round(CASE WHEN med IS NOT NULL THEN least(1, greatest(0, -0.6745 * (gap - med) / ({_Z})) / 3.5) ELSE 0 END, 5) AS burst FROM w",
    "jon01_recent_events": """WITH e AS (SELECT * FROM emails QUALIFY row_number() OVER (PARTITION BY mailbox, uid ORDER BY saved_at DESC) = 1), v AS (SELECT * FROM verdicts QUALIFY row_number() OVER (PARTITION BY mailbox, uid ORDER BY created_at DESC NULLS LAST) = 1)
SELECT e.mailbox, e.uid, e.subject, e.received_at, coalesce(score, 0) AS score, coalesce(verdict, 'ALLOW') AS verdict, len(coalesce(TRY_CAST(TRY_CAST(reasons_json AS JSON) AS VARCHAR[]), []))::BIGINT AS n_reasons FROM e LEFT JOIN v USING (mailbox, uid) ORDER BY received_at DESC NULLS LAST, uid DESC, mailbox LIMIT 50""",
    "jon05_display_fallback": "WITH p AS (SELECT lower(trim(from_display)) AS display, lower(from_addr) AS sender, count(*) AS messages FROM messages WHERE from_addr IS NOT NULL GROUP BY 1, 2) SELECT display, sender, messages FROM p WHERE display <> '' QUALIFY row_number() OVER (PARTITION BY display ORDER BY messages DESC, sender) = 1",
    "jon07_backfill": "SELECT audit_id, uid, coalesce((SELECT min(mailbox) FROM emails e WHERE e.uid = a.uid), '') AS mailbox FROM audit_log a",
    "snk01_upsert": "SELECT mailbox, uid, saved_at, subject FROM emails QUALIFY row_number() OVER (PARTITION BY mailbox, uid ORDER BY saved_at DESC, subject DESC NULLS LAST) = 1",
    "snk04_offsets": "SELECT mailbox, max(uid) AS last_uid FROM emails GROUP BY 1",
    "snk12_actions": "SELECT DISTINCT mailbox, uid, upper(trim(verdict)) AS level, CASE upper(trim(verdict)) WHEN 'BLOCK' THEN 'quarantine' WHEN 'REVIEW' THEN 'mark' WHEN 'FLAG' THEN 'mark' ELSE 'none' END AS action, CASE upper(trim(verdict)) WHEN 'REVIEW' THEN '$Suspicious' WHEN 'FLAG' THEN '$Phishing' END AS flag, upper(trim(verdict)) = 'BLOCK' AS moved FROM verdicts WHERE verdict IS NOT NULL",
    "set01_ordered_distinct": "WITH x AS (SELECT msg_id, list_concat(recipients, cc) AS a FROM messages), y AS (SELECT msg_id, unnest(a) AS v, generate_subscripts(a, 1) AS k FROM x), z AS (SELECT msg_id, v, min(k) AS k FROM y GROUP BY 1, 2), g AS (SELECT msg_id, string_agg(v, ',' ORDER BY k) AS e FROM z GROUP BY 1) SELECT m.msg_id, coalesce(e, '') AS everyone FROM messages m LEFT JOIN g USING (msg_id)",
    "grf01_graph": _EDGES + "SELECT src, dst, type, count(*) AS n FROM e GROUP BY 1, 2, 3",
    "jon10_ego_radius2": _EDGES + """, b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e), s AS (SELECT DISTINCT lower(from_addr) AS id FROM messages WHERE msg_id % 50 = 0 AND from_addr IS NOT NULL),
f AS (SELECT id AS start, id, 0 AS distance FROM s UNION ALL SELECT s.id, y, 1 FROM s JOIN b ON x = s.id UNION ALL SELECT s.id, b2.y, 2 FROM s JOIN b b1 ON b1.x = s.id JOIN b b2 ON b2.x = b1.y) SELECT start, id, min(distance)::BIGINT AS distance FROM f GROUP BY 1, 2""",
    "spc03_temporal_edges": _EDGES + "SELECT src, dst, type, count(*) AS n, min(t_at) AS first, max(t_at) AS last, round(count(*) / greatest((epoch_us(max(t_at)) - epoch_us(min(t_at))) / 86400e6, 1 / 24), 6) AS per_day FROM e GROUP BY 1, 2, 3",
    "spc04_shared_hosts": "WITH u AS (SELECT msg_id, unnest(urls) AS u FROM messages) SELECT 'domain:' || lower(u.domain) AS domain, count(DISTINCT u.normalized) AS links, count(DISTINCT msg_id) AS messages FROM u WHERE u.domain <> '' AND u.normalized IS NOT NULL GROUP BY 1",
    "spc01_close_vectors": "SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 4) AS similarity FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0 AND round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) >= 0.25",
    "spc08_metrics": _LAB + "SELECT bin / 1000 AS threshold, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 6) AS fpr FROM c",
    "htm01_structure": "SELECT msg_id, length(body_html) AS html_size, len(regexp_extract_all(body_html, '<a\\s[^>]*href')) AS anchor_count, len(regexp_extract_all(body_html, '<[a-z][^>]*>')) AS dom_node_count FROM messages WHERE body_html <> ''",
    "att03_filename_risk": f"""WITH a AS (SELECT msg_id, unnest(attachments) AS a, generate_subscripts(attachments, 1) - 1 AS pos FROM messages), n AS (SELECT msg_id, pos, coalesce(a.filename, '') AS f, string_split(lower(trim(coalesce(a.filename, ''))), '.') AS p FROM a)
SELECT msg_id, pos, CASE WHEN contains(f, '.') THEN lower(trim(string_split(f, '.')[-1])) ELSE '' END AS extension, CASE WHEN trim(f) = '' THEN 0 ELSE greatest(CASE WHEN len(p) > 1 AND p[-1] IN {_list(DANGEROUS)} THEN 0.9 ELSE 0 END,
 CASE WHEN len(p) >= 3 AND p[-1] IN {_list(DANGEROUS)} AND p[-2] IN {_list(DECOY_EXTENSIONS)} THEN 0.8 ELSE 0 END, CASE WHEN regexp_matches(f, '[\\x{{202A}}\\x{{202D}}\\x{{202E}}\\x{{200F}}]') THEN 1.0 ELSE 0 END, CASE WHEN length(trim(f)) > 120 THEN 0.3 ELSE 0 END) END::DOUBLE AS risk FROM n""",
    "str06_tumbling": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "str06_sessions": "WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k",
}
