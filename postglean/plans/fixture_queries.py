"""Queries of operators on bytes, markup, policies and streams over small invented inputs; their SQL states what must come out."""

from __future__ import annotations

import json
import tempfile
import warnings
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import models, text as tx, urls as ul
from ..operators import attachments as att, consistency as con, fusion, graph, headers as hd, history, markup, profiles
from ..policy import Policy, load_policy
from ..session import shared_folder
from ..sources import imap, mail, store
from ..sources.tables import ship_package, table
from ..streaming import ingest
from . import fixtures, pipeline

Query = Callable[[SparkSession, str], DataFrame]
SQL: dict[str, str] = {}
QUERIES: dict[str, Query] = {}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (bool, int)):
        return str(v)
    if isinstance(v, float):
        return f"{v!r}::DOUBLE"
    return "'" + v.replace("'", "''") + "'"


def expects(name: str, columns: str, rows: list[tuple]):
    """Registers a query whose result must be ``rows``."""

    def keep(f: Query) -> Query:
        def run(s: SparkSession, d: str) -> DataFrame:
            ship_package(s)
            return f(s, d)

        QUERIES[name] = run
        SQL[name] = f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) t({columns})"
        return f

    return keep


def _frame(s, rows, schema):
    return s.createDataFrame(rows, schema)


# Mail -----------------------------------------------------------------------------------------------------------------
@expects("src01_parse_mail", "name, subject, from_addr, body_plain, visible_text, spf_result, dkim_result, dmarc_result, links, files, received_at, offset_minutes", [
    ("plain", "Hello", "ada@velmora.example", "See hxxp://pay.umbra.test/now and http://ok.rivet.test/x.\n", "See hxxp://pay.umbra.test/now and http://ok.rivet.test/x.\n", "fail", "pass", "none", "p://pay.umbra.test/now|http://ok.rivet.test/x", "", "2026-01-15 09:30:00", 60),
    ("html", "Links", "bo@tallow.test", "", "Go  http://two.test  and http://three.test/a. \n", "none", "none", "none", "http://one.test/a|http://three.test/a", "", None, None),
    ("parts", "Files", "cy@kestrel.test", "one", "one", "none", "none", "pass", "", "a.docm:application/octet-stream:3:true|unknown:image/png:2:false", "2026-01-15 10:30:00", 0),
    ("empty", "", "", "", "", "none", "none", "none", "", "", None, None),
    ("none", "", "", "", "", "none", "none", "none", "", "", None, None),
])
def src01(s, d):
    r = mail.parse_messages(fixtures.raw_mail(s))
    files = F.array_join(F.transform("attachments", lambda a: F.concat_ws(":", a["filename"], a["content_type"], a["size"].cast("string"), a["has_macros"].cast("string"))), "|")
    return r.select("name", "subject", "from_addr", "body_plain", "visible_text", "spf_result", "dkim_result", "dmarc_result", F.array_join(F.transform("urls", lambda u: u["raw_url"]), "|").alias("links"), files.alias("files"), F.date_format("received_at", "yyyy-MM-dd HH:mm:ss").alias("received_at"), "offset_minutes")


@expects("src09_mail_source", "mailbox, uid, size", [("a@x.test", 3, 2), ("a@x.test", 7, 5), ("b@x.test", 1, 1)])
def src09(s, d):
    """The streaming source on a client that holds its mail in memory, read to its end."""
    s.dataSource.register(imap.mail_source(fixtures.Box, "postglean_fixture"))
    out = f"{shared_folder(s)}/mail-{id(s)}-{ingest.fresh()}"
    q = s.readStream.format("postglean_fixture").option("mailboxes", "a@x.test,b@x.test").load().writeStream.format("parquet").option("checkpointLocation", out + "-cp").trigger(once=True).start(out)
    q.awaitTermination()
    return s.read.parquet(out).select("mailbox", "uid", F.length("raw").alias("size"))


@expects("src10_mailboxes", "address", [("ada@x.test",), ("bo@y.test",)])
def src10(s, d):
    return _frame(s, [(a,) for a in imap.mailbox_list(["# accounts", "ada@x.test|h1", "", "bo@y.test|h2", "broken"])], "address string")


@expects("src11_policy", "name, value", [("block", "0.9"), ("brands", "velmora"), ("flag", "0.4"), ("learn_from", "always"), ("max_reasons", "3"), ("review", "0.7"), ("uncertainty_gate", "0.3")])
def src11(s, d):
    """A policy file, an override from the environment, and a value of a wrong kind, which is left out."""
    with tempfile.TemporaryDirectory() as folder, warnings.catch_warnings():
        warnings.simplefilter("ignore")
        path = Path(folder) / "policy.json"
        path.write_text(json.dumps({"block_threshold": 0.9, "flag_threshold": 0.3, "review_threshold": "high", "max_reasons": 3, "behavioral": {"update_policy": "always"}, "brands": {"Velmora": {"display": "Velmora", "domains": ["velmora.example"]}}}))
        p = load_policy(str(path), environment={"POSTGLEAN_FLAG": "0.4", "POSTGLEAN_UNCERTAINTY_GATE": "0.3"})
    return _frame(s, [(n, ",".join(v) if isinstance(v := getattr(p, n), dict) else str(v)) for n in ("block", "brands", "flag", "learn_from", "max_reasons", "review", "uncertainty_gate")], "name string, value string")


@expects("src08_image_texts", "name, image_text, codes", [("a.png", "PAY NOW", "http://qr.test/1"), ("b.png", "", "")])
def src08(s, d):
    f = _frame(s, [("a.png", bytearray(b"PAY NOW")), ("b.png", None)], "name string, payload binary")
    read = models.image_texts(f, lambda p: p.decode(), lambda p: ["http://qr.test/1", "tel:1"])
    return read.select("name", "image_text", F.array_join("code_urls", ",").alias("codes"))


@expects("txt11_model_hook", "t, plain, judged", [("please verify your identity", 0.88, 0.5), ("hello", 0.1, 0.25), (None, 0.1, 0.0)])
def txt11(s, d):
    f = _frame(s, [("please verify your identity",), ("hello",), (None,)], "t string")
    return f.select("t", models.text_probability(F.col("t")).alias("plain"), models.text_probability(F.col("t"), lambda xs: [0.5 if "verify" in x else 0.25 if x else 0.0 for x in xs]).alias("judged"))


# Text and links -------------------------------------------------------------------------------------------------------
@expects("txt01_normalize", "k, normal", [(1, "verify your account"), (2, "paypal login"), (3, "plain 1 text"), (4, "cafe"), (5, ""), (6, "aeoe ok")])
def txt01(s, d):
    f = _frame(s, [(1, "ｖｅｒｉｆｙ  your​  account"), (2, "‮pаypаl‬ lоgin"), (3, "  plain\t1 \n text "), (4, "саfе"), (5, None), (6, "æœ ok")], "k int, t string")
    return f.select("k", tx.normalize_text(F.col("t")).alias("normal"))


@expects("url03_normalize", "k, normal", [(1, "http://pay.umbra.test/a b"), (2, "http://a.test/x+y"), (3, "http://b.test/50%"), (4, ""), (5, "http://c.test/é")])
def url03(s, d):
    f = _frame(s, [(1, " hxxps://pay[.]umbra(.)test/a%20b "), (2, "http://a​.test/x+y"), (3, "http://b.test/50%"), (4, None), (5, "http://c.test/%C3%A9")], "k int, t string")
    return f.select("k", ul.normalize_url(F.col("t")).alias("normal"))


@expects("url04_html_links", "k, links", [(1, "http://a.test/1=Go|https://d.test=x|http://b.test/2="), (2, "")])
def url04(s, d):
    """Links of HTML: anchors first, of equal forms the first; then bare addresses outside of anchors and scripts."""
    html = b'From: a@x.test\nContent-Type: text/html\n\n<a href="http://a.test/1">Go</a> http://b.test/2. <a href="https://d.test">x</a><a href="mailto:a@x.test">m</a><a href="hxxp://a.test/1">again</a><script>http://no.test</script>'
    f = _frame(s, [(1, bytearray(html)), (2, bytearray(b"From: a@x.test\nContent-Type: text/html\n\n<p>none</p>"))], "k int, raw binary")
    return mail.parse_messages(f).select("k", F.array_join(F.transform("urls", lambda u: F.concat_ws("=", u["raw_url"], u["display_text"])), "|").alias("links"))


@expects("snk13_redirects", "src, target, hops", [("a", "d", 3), ("b", "d", 2), ("x", "y", 5), ("z", "z", 0)])
def snk13(s, d):
    """Chains followed at most five times; x and y lead to each other."""
    links = _frame(s, [("a",), ("b",), ("x",), ("z",)], "src string")
    return ul.expand_redirects(links, _frame(s, [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("q", None)], "src string, dst string"))


@expects("txt09_hash_embedding", "k, buckets, length", [(1, 2, 1.0), (2, 0, 0.0), (3, 1, 1.0), (4, 0, 0.0)])
def txt09(s, d):
    f = _frame(s, [(1, "pay now"), (2, ""), (3, "Pay PAY pay"), (4, None)], "k int, t string")
    e = tx.hash_embedding(F.col("t"))
    return f.select("k", e.alias("e")).select("k", F.size(F.filter("e", lambda x: x != 0)).alias("buckets"), F.round(F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 6).alias("length"))


# Markup ---------------------------------------------------------------------------------------------------------------
PAGE = (
    '<html><body><div style="display: none">secret words</div><p style="opacity:0">x</p><p style="color: red; background-color: red">same</p><p style="position:absolute; left:-9999px">far</p>'
    '<form action="http://steal.test/go"><input type="password"><input name="u"></form><form action="/own"><input></form><iframe src="http://frame.test/f"></iframe>'
    '<script src="http://js.test/a.js"></script><script>eval(atob("x")); window.location = "http://z.test"</script><img src="http://img.test/1.png"><img src="data:image/png;base64,AAAA"><link rel="stylesheet" href="http://css.test/s.css">'
    '<a href="http://one.test/a">http://two.test</a><a href="http://own.test/b">own.test</a><a href="mailto:a@own.test">mail</a><meta http-equiv="refresh" content="0"><div style="width:0; height:0px"></div></body></html>'
)
PAGE_COUNTS = {
    "form_count": 2, "input_count": 3, "password_input_count": 1, "iframe_count": 1, "script_count": 2, "inline_script_count": 1, "external_script_count": 1, "hidden_element_count": 3, "hidden_text_count": 2, "suspicious_style_attributes": 3,
    "zero_sized_element_count": 1, "transparent_element_count": 2, "offscreen_element_count": 1, "meta_refresh_count": 1, "data_uri_count": 1, "base64_like_count": 0, "external_resource_count": 4, "external_image_domain_count": 1,
    "external_css_domain_count": 1, "anchor_count": 3, "mismatched_anchor_count": 1, "form_external_action_count": 1, "password_form_count": 1, "credential_collection_indicator_count": 1, "hidden_text_length": 13, "js_redirect_count": 1,
    "dom_depth": 2, "dom_node_count": 22,
}


def _page(s):
    return _frame(s, [(PAGE, "own.test")], "html string, sender string").select(markup.measures("html", "sender").alias("m"))


@expects("htm02_counts", "name, n", sorted(PAGE_COUNTS.items()))
def htm02(s, d):
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"m.{n}").alias("n")) for n in PAGE_COUNTS])).alias("p")
    return _page(s).select(pairs).select("p.*")


@expects("htm10_texts", "visible, hidden, links, domains", [("secret words x same far http://two.test own.test mail", "secret words x", "http://one.test/a=http://two.test|http://own.test/b=own.test", "css.test,frame.test,img.test,js.test,one.test")])
def htm10(s, d):
    return _page(s).select("m.visible_text", "m.hidden_text", F.array_join(F.transform("m.links", lambda a: F.concat_ws("=", a["href"], a["text"])), "|").alias("links"), F.array_join("m.external_domains", ",").alias("domains")).toDF("visible", "hidden", "links", "domains")


@expects("htm07_risk", "context, form_risk_score, obfuscation_score, external_resource_score, html_context_risk, html_risk_score", [(0.0, 0.95, 0.5325, 0.2, 0.0, 0.475), (1.0, 0.95, 0.5325, 0.2, 1.0, 0.95)])
def htm07(s, d):
    r = _page(s).crossJoin(_frame(s, [(0.0,), (1.0,)], "context double"))
    return r.withColumn("r", markup.html_scores(F.col("m"), markup.script_features(F.col("m")), F.col("context"))).select("context", "r.*")


@expects("htm05_scripts", "tokens, encoded, risk", [(3, 0, 0.65)])
def htm05(s, d):
    r = _page(s).withColumn("js", markup.script_features(F.col("m")))
    return r.select(F.col("js.suspicious_javascript_tokens").cast("int").alias("tokens"), F.col("js.encoded_javascript_indicators").cast("int").alias("encoded"), F.round(markup.script_risk(F.col("js")), 4).alias("risk"))


@expects("htm08_context", "reputation, failed, credential, risk", [(0.0, False, 0.0, 0.0), (0.2, True, 0.1, 0.5), (0.9, True, 0.1, 0.9), (0.0, False, 1.0, 1.0)])
def htm08(s, d):
    f = _frame(s, [(0.0, False, 0.0), (0.2, True, 0.1), (0.9, True, 0.1), (0.0, False, 1.0)], "reputation double, failed boolean, credential double")
    return f.withColumn("risk", markup.context_risk(F.col("reputation"), F.col("failed"), F.col("credential")))


# Files ----------------------------------------------------------------------------------------------------------------
FILES = [
    ("plain.pdf", "pdf", 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("lure.pdf", "pdf", 0, 1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.55), ("macro.docm", "docx", 1, 0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.6), ("table.xlsx", "xlsx", 1, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ("outer.zip", "zip", 2, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.4), ("bill.pdf", "zip", 1, 1, 1.0, 1.0, 0.0, 0.0, 0.0, 0.7), ("art.svg", "svg", 0, 0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.6), ("noise.bin", "unknown", 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ("bomb.zip", "zip", 1, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.7), ("empty.txt", "unknown", 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("links.zip", "zip", 1, 2, 0.0, 0.0, 0.0, 0.0, 0.5, 0.6), ("linked.docx", "docx", 1, 1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5),
]


@expects("att11_inspect", "filename, magic_type, depth, links, extension_mismatch, mime_mismatch, macro, pdf_action, script, risk", FILES)
def att11(s, d):
    r = att.inspect_files(fixtures.files(s))
    return r.select("filename", "content.magic_type", F.col("content.archive_depth").alias("depth"), F.col("content.embedded_url_count").alias("links"), "features.extension_mismatch", F.col("features.mime_magic_mismatch").alias("mime_mismatch"), F.col("features.macro_indicator").alias("macro"), F.col("features.suspicious_pdf_action").alias("pdf_action"), F.col("features.script_indicator").alias("script"), "risk")


@expects("att10_features", "filename, nested, external, office, size_part, entropy_zero, bad", [("bomb.zip", 0.0, 0.0, 0.0, True, False, 0.0), ("linked.docx", 0.0, 1.0, 1.0, True, False, 0.0), ("outer.zip", 1.0, 0.0, 0.0, True, False, 0.0), ("noise.bin", 0.0, 0.0, 0.0, True, False, 1.0), ("empty.txt", 0.0, 0.0, 0.0, False, True, 0.0)])
def att10(s, d):
    """Features of some files, with the hash of one on the list of bad ones."""
    rows = fixtures.files(s).where(F.col("filename").isin("bomb.zip", "linked.docx", "outer.zip", "noise.bin", "empty.txt")).withColumn("content", att.content("payload"))
    bad = F.array(F.sha2(F.lit(bytearray([0, 1, 2, 250, 0, 99])), 256))
    r = rows.withColumn("f", att.file_features(F.col("filename"), F.col("content_type"), F.col("content"), bad))
    return r.select("filename", F.col("f.nested_archive_count").alias("nested"), F.col("f.external_relationship_count").alias("external"), F.col("f.suspicious_office_relationship").alias("office"), (F.col("f.attachment_size_anomaly") > 0).alias("size_part"), (F.col("f.file_entropy") == 0).alias("entropy_zero"), F.col("f.attachment_hash_reputation").alias("bad"))


@expects("att12_aggregate", "msg, attachment_count, macro_indicator, extension_mismatch, attachment_risk_score, evidence", [(0, 6, 1.0, 1.0, 0.7, 6), (1, 6, 0.0, 0.0, 0.7, 6)])
def att12(s, d):
    """The fixture's files as attachments of two messages: aggregate with risks, and the number of evidence items."""
    names = [n for n, _, _ in fixtures.payloads()]
    r = att.inspect_files(fixtures.files(s)).withColumn("msg", F.when(F.col("filename").isin(*names[:6]), 0).otherwise(1))
    agg = att.aggregate_files(r, ["msg"], True).select("msg", F.col("attachment_count").cast("int").alias("attachment_count"), "macro_indicator", "extension_mismatch", "attachment_risk_score")
    return agg.join(att.file_evidence(r, ["msg"]).select("msg", F.size("evidence").alias("evidence")), "msg")


# Scoring --------------------------------------------------------------------------------------------------------------
def _samples(s):
    return fixtures.messages(s)


@expects("fus01_sample_verdicts", "name, level, score, action", [("phish", "REVIEW", 1.0, "mark"), ("legit", "ALLOW", 0.1, "none"), ("bare", "ALLOW", 0.1, "none")])
def fus01(s, d):
    """Three messages through the whole plan without history: a phishing mail with every sort of sign, a plain one, an empty one."""
    r = pipeline.score(_samples(s), registry=pipeline.default_registry(False))
    return r.join(_samples(s).select("msg_id", F.col("mailbox").alias("name")), "msg_id").select("name", "level", F.round("score", 4).alias("score"), "action.action")


@expects("con12_evidence", "category, feature, value, severity", [
    ("CONSISTENCY", "brand_domain_mismatch", "claims PayPal from evil.test", "medium"), ("CONSISTENCY", "replyto_identity_mismatch", "reply-to other.test", "high"), ("CONSISTENCY", "display_href_mismatch", "1/1 links", "critical"),
    ("CONSISTENCY", "qr_context_mismatch", "QR -> qr.test", "high"), ("CONSISTENCY", "subject_body_mismatch", "0.80", "high"),
    ("HTML", "password_form_external_action", "1 form(s)", "critical"), ("ATTACHMENT", "attachment_risk", "bill.pdf.exe", "critical"), ("TEXT", "phrase", "0.90", "critical"),
    ("CONSISTENCY", "attachment_context_mismatch", "0.70", "high"),
])
def con12(s, d):
    """Named evidence of the phishing sample, but for the tactics."""
    r = pipeline.score(_samples(s), registry=pipeline.default_registry(False)).where("mailbox = 'phish'")
    return r.select(F.explode("evidence").alias("e")).select("e.category", "e.feature", "e.value", "e.severity").where("category <> 'TACTIC'")


@expects("con13_contradiction", "k, contradiction, consistency", [(1, 0.0, 1.0), (2, 0.5, 0.2), (3, 1.0, 0.0)])
def con13(s, d):
    f = _frame(s, [(1, 0, 0.0), (2, 2, 0.8), (3, 6, 1.0)], "k int, high int, v double")
    made = {n: F.when(F.lit(i) < F.col("high"), F.col("v")).otherwise(0.0) for i, n in enumerate(con.FEATURES)}
    a, b = con.contradiction(made)
    return f.select("k", a.alias("contradiction"), b.alias("consistency"))


@expects("fus02_scores", "p, fired, score, calibrated", [(0.1, 0.0, 0.1, 0.1), (0.95, 2.0, 1.05, 1.0), (0.5, 1.0, 0.6, 0.6)])
def fus02(s, d):
    f = _frame(s, [(0.1, 0.0), (0.95, 2.0), (0.5, 1.0)], "p double, fired double").withColumn("score", F.round(fusion.raw_score(F.col("p"), F.col("fired")), 4))
    return f.withColumn("calibrated", fusion.calibrate(F.col("score")))


@expects("exp01_explanation", "line, text", [(1, "1. Asks for sign-in data."), (2, "2. Sender, reply and return addresses don't agree."), (3, "3. Top evidence: TEXT:phrase=0.88"), (4, "4. Component agreement 0.40, disagreement 0.60."), (5, "5. For review: risk 0.90 is high and so is the uncertainty, 0.50.")])
def exp01(s, d):
    f = _frame(s, [("REVIEW", ["High credential_request confidence: 0.95"], 1.0, [("TEXT", "phrase", "0.88")], 0.4, 0.6, 0.9, 0.5)], "level string, why array<string>, n double, e array<struct<category:string,feature:string,value:string>>, a double, d double, p double, u double")
    told = fusion.explain(F.col("level"), F.col("why"), F.col("n"), F.col("e"), F.col("a"), F.col("d"), F.col("p"), F.col("u"), Policy())
    return f.select(F.posexplode(F.split(told, "\n")).alias("line", "text")).select((F.col("line") + 1).alias("line"), "text")


@expects("udf01_isolation", "detector, failed, has_plan_time", [("html", False, True), ("broken", True, True), ("consistency", False, True), ("intent", False, True)])
def udf01(s, d):
    """A detector that can't be planned: named, replaced by its fallback, and the others go on; one registered again moves to the end."""
    r = pipeline.default_registry(False).unregister("attachment")
    kept = dict(r.detectors)
    r = pipeline.Registry({"html": kept["html"]}).register("broken", lambda rows, policy: rows.select("no_such_column"), lambda rows, policy: rows)
    r.register("consistency", kept["consistency"]).register("intent", kept["intent"])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        made = pipeline.score(_samples(s), registry=r)
    marked = made.where("array_contains(degraded, 'broken')").count() == 3
    return _frame(s, [(n, n in r.failed and marked, r.plan_ms[n] > 0) for n in r.detectors], "detector string, failed boolean, has_plan_time boolean")


@expects("udf02_degraded_rows", "name, degraded, html_size", [("bad", True, 0), ("fine", False, 8)])
def udf02(s, d):
    """A body on which the parser fails marks its row, gives zeros and ends nothing."""
    f = _frame(s, [("bad", "<p>x</p>"), ("fine", "<p>x</p>")], "name string, html string")
    fail = fixtures.failing(markup.measure, lambda html, sender: sender == "bad")
    m = markup.measures_by(fail)(F.col("html"), F.col("name"))
    return f.withColumn("m", m).select("name", "m.degraded", F.col("m.html_size").cast("int").alias("html_size"))


@expects("beh15_gated_learning", "mode, learnt", [("always", 3), ("only_below_block", 2), ("confirmed_only", 1)])
def beh15(s, d):
    levels = _frame(s, [(1, "BLOCK"), (2, "REVIEW"), (3, "ALLOW")], "msg_id bigint, level string")
    n = [(mode, pipeline.learn(None, _samples(s), levels, Policy(learn_from=mode)).count()) for mode in ("always", "only_below_block", "confirmed_only")]
    return _frame(s, n, "mode string, learnt int")


@expects("beh16_profile_store", "sender, messages, display_ok, display_total", [("bo@evil.test", 2, 1, 1), ("cy@kind.test", 2, 1, 1), ("", 2, 0, 0)])
def beh16(s, d):
    """Profiles saved, loaded, and folded with the next day's messages."""
    folder = f"{shared_folder(s)}/profiles-{ingest.fresh()}"
    obs = history.observations(_samples(s))
    profiles.fold(None, obs).save(f"{folder}/1")
    later = obs.withColumns({"msg_id": F.col("msg_id") + 10, "at": F.col("at") + F.expr("interval 1 day")})
    p = profiles.fold(profiles.Profiles.load(s, f"{folder}/1", profiles.SENDER), later)
    return p.totals.select("sender", F.col("messages").cast("int").alias("messages"), F.col("display_ok").cast("int").alias("display_ok"), F.col("display_total").cast("int").alias("display_total"))


@expects("snk08_passwords", "given, fits", [("right", True), ("wrong", False), ("", False)])
def snk08(s, d):
    kept = store.password_hash("right", b"0123456789abcdef", 1000)
    return _frame(s, [(p, store.password_fits(p, kept, 1000)) for p in ("right", "wrong", "")], "given string, fits boolean")


@expects("snk08_user_upsert", "email, name, created_at", [("a@x.test", "Ada L.", "2025-01-01"), ("b@x.test", "Bo", "2025-02-01")])
def snk08u(s, d):
    old = _frame(s, [("a@x.test", "Ada", "2025-01-01")], "email string, name string, created_at string")
    new = _frame(s, [("a@x.test", "Ada L.", "2025-02-01"), ("b@x.test", "Bo", "2025-02-01")], "email string, name string, created_at string")
    return store.upsert_keeping(old, new, ["email"], ["created_at"]).select("email", "name", "created_at")


@expects("snk06_tables", "name, made", [(n, True) for n in sorted(store.SCHEMAS)])
def snk06(s, d):
    folder = f"{shared_folder(s)}/store-{ingest.fresh()}"
    first, again = store.create_tables(s, folder), store.create_tables(s, folder)
    return _frame(s, [(n, n in first and not again) for n in sorted(store.SCHEMAS)], "name string, made boolean")


@expects("str04_waits", "k, seconds", [(1, 1.0), (2, 2.0), (3, 4.0), (4, 8.0), (5, 16.0), (6, 32.0), (7, 60.0)])
def str04(s, d):
    slept: list[float] = []
    try:
        imap.persistent(lambda: (_ for _ in ()).throw(OSError("down")), 8, slept.append)
    except OSError:
        pass
    return _frame(s, list(enumerate(slept, 1)), "k int, seconds double")


def str01(s, d):
    """The messages as a stream of files, read to its end in two runs of one query: each message comes once."""
    ship_package(s)
    out = f"{shared_folder(s)}/stream-{ingest.fresh()}"
    m = table(s, d, "messages")
    for _ in range(2):
        stream = s.readStream.schema(m.schema).parquet(f"{d}/messages.parquet*")
        q = stream.select("msg_id", "mailbox").writeStream.format("parquet").option("checkpointLocation", out + "-cp").trigger(availableNow=True).start(out)
        q.awaitTermination()
    return s.read.parquet(out).groupBy("mailbox").agg(F.count("*").alias("n"))


QUERIES["str01_resumed_stream"] = str01
SQL["str01_resumed_stream"] = "SELECT mailbox, count(*) AS n FROM messages GROUP BY 1"


def str03(s, d):
    """Running profiles of pairs kept by the stream's state, as they stand at its end."""
    ship_package(s)
    out = f"{shared_folder(s)}/state-{ingest.fresh()}"
    m = table(s, d, "messages")
    was = s.conf.get("spark.sql.streaming.stateStore.providerClass")
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        obs = history.observations(s.readStream.schema(m.schema).parquet(f"{d}/messages.parquet*")).select("sender", "recipient", (F.unix_micros("at") / 1e6).alias("at"), "n_files")
        rows = ingest.running_profiles(obs, ["sender", "recipient"])
        q = rows.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", out + "-cp").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        s.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    last = s.read.parquet(out).groupBy("sender", "recipient").agg(F.max_by(F.struct("messages", "file_messages", "mean_interval"), "messages").alias("x"))
    return last.select("sender", "recipient", "x.messages", "x.file_messages", F.round("x.mean_interval", 3).alias("mean_interval"))


QUERIES["str03_running_pairs"] = str03
SQL["str03_running_pairs"] = """WITH o AS (SELECT lower(coalesce(from_addr, '')) AS sender, lower(coalesce(recipients[1], '')) AS recipient, coalesce(len(attachments), 0) AS f, epoch_us(ingested_at) / 1e6 AS t FROM messages)
SELECT sender, recipient, count(*) AS messages, count(*) FILTER (WHERE f > 0) AS file_messages, round((max(t) - min(t)) / nullif(count(*) - 1, 0), 3) AS mean_interval FROM o GROUP BY 1, 2"""


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
