"""Queries of the message-risk operators with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import blocks, robust, text as tx, urls as ul
from ..operators import attachments as att, campaigns, evaluation as ev, evidence as evd, fusion, graph, headers as hd, history, intent as it, markup, consistency as con
from ..policy import Policy
from ..sources import mail, store
from ..sources.tables import table
from ..streaming import ingest
from . import fixtures, pipeline

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Levels of all messages per mailbox, from the full scoring plan, history included."""
    v = pipeline.score(table(spark, folder, "messages"))
    return v.groupBy("mailbox", "level").agg(F.count("*").alias("messages"), F.round(F.avg("calibrated_probability"), 6).alias("mean_probability"))


def _m(s, d):
    return table(s, d, "messages")


def _mail(s, d):
    """Stored emails once each, with the bare sender, in history order."""
    from ..operators.event_features import bare_address

    e = table(s, d, "emails").where("received_at is not null").withColumn("sender", bare_address(F.col("sender"))).where("sender is not null")
    return e.groupBy("mailbox", "uid").agg(F.max("sender").alias("sender"), F.max("received_at").alias("at"), F.max(F.length(F.coalesce("subject", F.lit("")))).cast("double").alias("len"))


_ORDER = ["at", "mailbox", "uid"]


def _recent(rows, x, cut):
    """The up to ``RESERVOIR`` earlier values of ``x`` of the sender, as ``xs``."""
    rows = blocks.with_recent(rows, ["sender"], _ORDER, history.RESERVOIR, cut)
    w = Window.partitionBy("sender", "_block").orderBy(*_ORDER).rowsBetween(-history.RESERVOIR, -1)
    return rows.withColumn("xs", F.collect_list(x).over(w)).where("_own")


def _texts(s, d, *names):
    """``msg_id, field, text`` of whole texts; null reads as ''."""
    fields = F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(n, F.lit("")).alias("text")) for n in names or ("subject", "body_plain", "visible_text")])
    return _m(s, d).select("msg_id", F.explode(fields).alias("x")).select("msg_id", "x.*")


def txt02(s, d):
    return _texts(s, d).select("msg_id", "field", tx.fold_confusables(F.col("text")).alias("folded"))


def txt07(s, d):
    t = table(s, d, "documents").select(F.lower("lang").alias("lang"), F.explode(tx.tokens(F.col("text"))).alias("word"))
    return t.groupBy("lang", "word").agg(F.count("*").alias("n"))


def txt08(s, d):
    return _texts(s, d).select("msg_id", "field", F.size(tx.token_set(F.col("text"))).cast("bigint").alias("words"))


def txt10(s, d):
    return _m(s, d).select("msg_id", tx.phrase_probability(F.col("body_plain")).alias("probability"))


def txt12(s, d):
    return _m(s, d).select("msg_id", *[tx.tactic(F.col("body_plain"), n).alias(n) for n, _, _ in tx.TACTICS])


def url01(s, d):
    u = _m(s, d).select("msg_id", F.posexplode("urls").alias("pos", "u"))
    return u.select("msg_id", F.col("pos").cast("bigint").alias("pos"), ul.authority(F.col("u.raw_url")).alias("authority"), ul.scheme(F.col("u.raw_url")).alias("scheme"), ul.host(F.col("u.raw_url")).alias("host"))


def url05(s, d):
    return _m(s, d).select("msg_id", F.explode(ul.urls_in_text(F.col("body_plain"))).alias("url")).groupBy("msg_id", "url").agg(F.count("*").alias("n"))


def url07(s, d):
    return _texts(s, d).select("msg_id", "field", ul.domain_in_text(F.col("text")).alias("domain"))


def url10(s, d):
    return _m(s, d).select("msg_id", ul.suspicion(F.col("urls")).alias("suspicion"))


def url11(s, d):
    u = _m(s, d).select("msg_id", F.posexplode("urls").alias("pos", "u"))
    f = ul.lexical_features(F.col("u.raw_url"))
    return u.select("msg_id", F.col("pos").cast("bigint").alias("pos"), f.alias("f")).select("msg_id", "pos", "f.url_length", F.round("f.digit_ratio", 6).alias("digit_ratio"), "f.subdomain_depth", F.round("f.host_entropy", 6).alias("host_entropy"), "f.risky_tld", "f.has_at")


def htm09(s, d):
    return _texts(s, d).select("msg_id", "field", F.round(tx.entropy(F.col("text")), 6).alias("entropy"))


def hdr01(s, d):
    m = _m(s, d).select("msg_id", hd.auth_failures(F.col("headers")).alias("a"), hd.header_anomalies(F.col("from_addr"), F.col("return_path"), F.col("reply_to"), F.col("from_display")).alias("h"))
    return m.select("msg_id", "a.*", "h.*", hd.anomaly_count(F.col("a"), F.col("h")).alias("fired"))


def con09(s, d):
    f = con.link_features(F.col("urls"), F.col("extracted_image_text"), F.col("extracted_qr_urls"), F.col("visible_text"))
    return _m(s, d).select("msg_id", *[F.round(f[k], 6).alias(k) for k in ("display_href_mismatch", "display_domain_mismatch", "ocr_url_mismatch", "qr_context_mismatch")])


def con10(s, d):
    a, b = tx.token_set(F.col("subject")), tx.token_set(F.col("visible_text"))
    return _m(s, d).select("msg_id", F.round(tx.jaccard(a, b), 6).alias("jaccard"), F.round(tx.containment(a, b), 6).alias("containment"))


def int01(s, d):
    t = it.tactics(F.col("body_plain"), F.size("urls") > 0, F.size("attachments") > 0, F.size("extracted_qr_urls") > 0)
    return _m(s, d).select("msg_id", *[v.alias(k) for k, v in t.items()])


def int02(s, d):
    """Derived scores on a grid of tactic and signal values made of the verdict scores."""
    v = table(s, d, "verdicts").select("score").distinct()
    x = F.col("score")
    t = {"urgency": x, "authority_impersonation": 1 - x, "credential_request": x * 0.5, "payment_gift_card": F.least(x + 0.3, F.lit(1.0)), "link_bait": x * x, "attachment_lure": 0.6 * x}
    made = it.intents(t, x, 1 - x, x * 0.7, x, F.when(x > 0.5, 1.0).otherwise(0.0))
    return v.select("score", *[F.round(c, 6).alias(k) for k, c in made.items()])


def fus04(s, d):
    p, u = F.col("score"), F.pmod(F.col("score") * 7, F.lit(1.0))
    return table(s, d, "verdicts").where("score is not null").select(p.alias("p"), F.round(u, 6).alias("u")).distinct().select("p", "u", fusion.decide(F.col("p"), F.col("u"), Policy()).alias("level"))


def fus06(s, d):
    v = table(s, d, "verdicts").where("score is not null").select(F.col("score").alias("p")).distinct()
    risks = F.array(F.col("p"), F.lit(0.0), F.lit(1.0) - F.col("p"), F.col("p") * 0.5)
    r = v.withColumn("d", fusion.disagreement(risks))
    return r.select("p", F.round("d", 5).alias("d"), *[F.round(c, 3).alias(k) for k, c in fusion.uncertainty_report(F.col("d"), 4, F.col("p")).items()])


def _items(s, d):
    v = table(s, d, "verdicts").where("score is not null").withColumn("r", F.explode(F.from_json("reasons_json", "array<string>")))
    x = F.col("score")
    return v.select("mailbox", "uid", F.upper(F.split("r", r"\.")[0]).alias("category"), F.col("r").alias("feature"), F.col("created_at"), x.alias("normalized_score"), evd.severity(x).alias("severity")).select(
        "*", evd.evidence_id(F.col("category"), F.col("feature"), F.lit(""), F.lit("stored")).alias("evidence_id"), evd.rank_score(F.col("normalized_score"), F.col("severity"), F.lit("high")).alias("rank_score")
    )


def evd03(s, d):
    return _items(s, d).select("category", "feature", "evidence_id").distinct()


def evd04(s, d):
    return _items(s, d).groupBy("mailbox", "uid", "feature", "severity", "rank_score").agg(F.count("*").alias("n"))


def evd05(s, d):
    r = evd.deduplicate(_items(s, d).withColumn("seq", F.unix_micros("created_at")), ["mailbox", "uid"])
    return r.select("mailbox", "uid", "evidence_id", "rank_score", "seq")


def top01(s, d):
    r = evd.deduplicate(_items(s, d).withColumn("seq", F.unix_micros("created_at")), ["mailbox", "uid"])
    return evd.top(r, ["mailbox", "uid"], 3).select("mailbox", "uid", F.col("position").cast("bigint").alias("position"), "feature", "rank_score")


def evd06(s, d):
    return evd.by_category(_items(s, d), ["mailbox"]).withColumn("max_score", F.round("max_score", 6))


def agg01(s, d):
    m, cut = blocks.blocked(_mail(s, d), ["sender"], "at")
    m = _recent(m, "len", cut).withColumn("med", robust.median(F.col("xs")))
    m = m.withColumn("mad", robust.mad(F.col("xs"), F.col("med")))
    return m.select("mailbox", "uid", F.round("med", 6).alias("med"), F.round("mad", 6).alias("mad"), F.round(robust.score_of_z(robust.robust_z(F.col("len"), F.col("med"), F.col("mad"))), 6).alias("z_score"))


def agg05(s, d):
    m, cut = blocks.blocked(_mail(s, d), ["sender"], "at")
    m = blocks.running(m, ["sender"], _ORDER, {"n": F.lit(1)}, {}, cut)
    m = blocks.running(m, ["sender", "mailbox"], _ORDER, {"k": F.lit(1)}, {}, cut)
    return m.select("mailbox", "uid", F.round(robust.novelty(F.col("k"), F.col("n")), 6).alias("novelty"), F.round(F.when(F.col("n") > 0, 1 / (1 + F.col("n") / 5.0)).otherwise(1.0), 6).alias("newness"))


def agg06(s, d):
    a = (F.hour("at") + F.minute("at") / 60.0) * 3.141592653589793 / 12
    m = _mail(s, d).groupBy("sender").agg(F.sum(F.sin(a)).alias("y"), F.sum(F.cos(a)).alias("x"), F.count("*").alias("n"))
    return m.select("sender", "n", F.round(robust.circular_hour(F.col("y"), F.col("x")), 4).alias("usual_hour"))


def agg08(s, d):
    m = _mail(s, d).groupBy("sender", F.weekday("at").cast("bigint").alias("day")).agg(F.count("*").alias("n"))
    t = m.groupBy("sender").agg(F.max(F.struct("n", (-F.col("day")).alias("d"))).alias("b"), F.sum("n").alias("all"))
    return t.select("sender", F.when(F.col("b.n") / F.col("all") >= 0.5, -F.col("b.d")).alias("usual_day"))


def agg13(s, d):
    m, cut = blocks.blocked(_mail(s, d), ["sender", "mailbox"], "at")
    m = blocks.running(m, ["sender", "mailbox"], _ORDER, {}, {"last": F.col("at")}, cut).withColumn("gap", (F.unix_micros("at") - F.unix_micros("last")) / 1e6)
    g = m.groupBy("sender", "mailbox").agg(F.count("*").alias("n"), F.median("gap").alias("g"))
    return g.select("sender", "mailbox", "n", F.round("g", 3).alias("median_interval"), F.round(1 / (1 + F.col("n") / 3.0), 6).alias("newness"))


def agg14(s, d):
    m = _mail(s, d).groupBy("sender").agg(F.count("*").alias("n"), F.min("at").alias("a"), F.max("at").alias("b"))
    return m.select("sender", "n", F.round(F.col("n") / F.greatest((F.unix_micros("b") - F.unix_micros("a")) / 86400e6, F.lit(1 / 24)), 4).alias("per_day"))


def agg15(s, d):
    return store.verdict_counts(table(s, d, "verdicts"), ["mailbox", F.upper(F.trim("verdict")).alias("verdict")])


def beh02(s, d):
    m, cut = blocks.blocked(_mail(s, d), ["sender"], "at")
    m = blocks.running(m, ["sender"], _ORDER, {}, {"last": F.col("at")}, cut).withColumn("gap", (F.unix_micros("at") - F.unix_micros("last")) / 1e6)
    m = _recent(m, "gap", cut).withColumn("med", robust.median(F.col("xs")))
    m = m.withColumn("mad", robust.mad(F.col("xs"), F.col("med")))
    z = robust.robust_z(F.col("gap"), F.col("med"), F.col("mad"))
    return m.select("mailbox", "uid", F.round(F.when(F.size("xs") > 0, F.least(F.greatest(-z, F.lit(0.0)) / 3.5, F.lit(1.0))).otherwise(0.0), 5).alias("burst"))


def beh14(s, d):
    return history.summary(history.behaviour(history.observations(_m(s, d))))


def jon01(s, d):
    r = store.recent_events(store.latest(table(s, d, "emails"), ["mailbox", "uid"], ["saved_at"]), store.latest(table(s, d, "verdicts"), ["mailbox", "uid"], ["created_at"]), 50)
    return r.select("mailbox", "uid", "subject", "received_at", "score", "verdict", F.size("reasons").cast("bigint").alias("n_reasons"))


def jon05(s, d):
    p = _m(s, d).where("from_addr is not null").groupBy(F.lower(F.trim("from_display")).alias("display"), F.lower("from_addr").alias("sender")).agg(F.count("*").alias("messages"))
    return store.best_known(p)


def jon07(s, d):
    a = table(s, d, "audit_log").select("audit_id", "uid")
    return store.with_mailbox(a, table(s, d, "emails")).select("audit_id", "uid", "mailbox")


def snk01(s, d):
    return store.latest(table(s, d, "emails").select("mailbox", "uid", "saved_at", "subject"), ["mailbox", "uid"], ["saved_at"])


def snk04(s, d):
    return store.offsets(table(s, d, "emails"))


def snk12(s, d):
    r = table(s, d, "verdicts").select("mailbox", "uid", F.upper(F.trim("verdict")).alias("level")).where("level is not null").distinct()
    return r.select("mailbox", "uid", "level", fusion.mailbox_action(F.col("level")).alias("a")).select("mailbox", "uid", "level", "a.action", "a.flag", "a.moved")


def set01(s, d):
    return _m(s, d).select("msg_id", F.array_distinct(F.concat("recipients", "cc")).alias("x")).select("msg_id", F.concat_ws(",", "x").alias("everyone"))


def grf01(s, d):
    return graph.edges(_m(s, d)).groupBy("src", "dst", "type").agg(F.count("*").alias("n"))


def jon10(s, d):
    """Around the senders of every fiftieth message, over all edges."""
    start = _m(s, d).where("msg_id % 50 = 0").select(F.lower("from_addr").alias("id"))
    return graph.ego(graph.edges(_m(s, d)), start, 2).select("start", "id", F.col("distance").cast("bigint").alias("distance"))


def spc01v(s, d):
    return campaigns.close_vectors(table(s, d, "embeddings"), 0.25).select("query_id", "vec_id", F.round("similarity", 4).alias("similarity"))


def spc03(s, d):
    return graph.temporal(graph.edges(_m(s, d)))


def spc04(s, d):
    return graph.shared_hosts(graph.edges(_m(s, d)))


def _labelled(s, d):
    v = table(s, d, "verdicts").where("verdict is not null")
    return v.select("score", F.upper(F.trim("verdict")).isin("BLOCK", "REVIEW").cast("int").alias("label"))


def spc08(s, d):
    return ev.rates(ev.curve(_labelled(s, d))).select("threshold", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "fpr")])


def spc09(s, d):
    m = _m(s, d).where("body_plain is not null").select("msg_id", "body_plain")
    changed = ev.disturbed(m, "body_plain").withColumn("p", tx.phrase_probability(tx.normalize_text(F.col("body_plain"))))
    return changed.groupBy("mutation").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_probability"))


def htm01(s, d):
    m = _m(s, d).where("body_html <> ''").withColumn("m", markup.measures("body_html", hd.clean_domain(F.col("from_addr"))))
    return m.select("msg_id", F.col("m.html_size").alias("html_size"), F.col("m.anchor_count").alias("anchor_count"), F.col("m.dom_node_count").alias("dom_node_count"))


def htm07(s, d):
    m = _m(s, d).where("body_html <> ''").withColumn("m", markup.measures("body_html", hd.clean_domain(F.col("from_addr"))))
    return m.withColumn("r", markup.html_scores(F.col("m"), markup.script_features(F.col("m")), F.lit(0.0))).select("msg_id", "r.*")


def att03(s, d):
    a = _m(s, d).select("msg_id", F.posexplode("attachments").alias("pos", "a"))
    return a.select("msg_id", F.col("pos").cast("bigint").alias("pos"), att.extension(F.col("a.filename")).alias("extension"), att.filename_risk(F.col("a.filename")).alias("risk"))


def att11(s, d):
    return att.inspect_files(fixtures.files(s)).select("filename", "content.magic_type", "risk", "features.*")


def src01(s, d):
    return mail.parse_messages(fixtures.raw_mail(s)).select("name", "subject", "from_addr", "body_plain", "spf_result", "dkim_result", "dmarc_result", F.size("urls").alias("n_urls"), F.size("attachments").alias("n_files"))


def str06(s, d):
    return ingest.tumbling(table(s, d, "events"), "ts", "1 day", "event_type")


def str06s(s, d):
    return ingest.sessions(table(s, d, "events"), "ts", "6 hours", "user_id").select("user_id", "start", "n")


def exp01(s, d):
    return pipeline.score(_m(s, d)).select("msg_id", "level", "score", "explanation")


def queries() -> dict[str, Query]:
    return {
        "txt02_confusable_fold": txt02, "txt07_token_bag": txt07, "txt08_token_set": txt08, "txt10_phrase_ladder": txt10, "txt12_tactics": txt12,
        "url01_authority": url01, "url05_urls_in_text": url05, "url07_domain_in_text": url07, "url10_suspicion": url10, "url11_lexical": url11, "htm09_text_entropy": htm09,
        "hdr01_header_rules": hdr01, "con09_links": con09, "con10_jaccard": con10,
        "int01_tactics": int01, "int02_derived": int02, "fus04_decide": fus04, "fus06_uncertainty": fus06,
        "evd03_evidence_id": evd03, "evd04_rank": evd04, "evd05_dedupe": evd05, "evd06_by_category": evd06, "top01_evidence_topk": top01,
        "agg01_running_median_mad_z": agg01, "agg05_novelty": agg05, "agg06_circular_hour": agg06, "agg08_usual_weekday": agg08, "agg13_relationship": agg13, "agg14_per_day": agg14, "agg15_verdict_counts": agg15,
        "beh02_burst": beh02, "beh14_vector": beh14, "jon01_recent_events": jon01, "jon05_display_fallback": jon05, "jon07_backfill": jon07, "jon10_ego_radius2": jon10,
        "snk01_upsert": snk01, "snk04_offsets": snk04, "snk12_actions": snk12, "set01_ordered_distinct": set01, "grf01_graph": grf01,
        "spc01_close_vectors": spc01v, "spc03_temporal_edges": spc03, "spc04_shared_hosts": spc04,
        "spc08_metrics": spc08, "spc09_mutations": spc09, "htm01_structure": htm01, "htm07_risk": htm07, "att03_filename_risk": att03,
        "att11_inspect": att11, "src01_parse_mail": src01, "str06_tumbling": str06, "str06_sessions": str06s, "exp01_explained_verdicts": exp01, "fus01_flagship": flagship,
    }


def oracle_sql() -> dict[str, str]:
    from .risk_sql import SQL

    return SQL
