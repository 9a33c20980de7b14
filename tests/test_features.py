"""Text, link, header, file and markup functions on small fixtures."""

import math

from pyspark.sql import functions as F

from postglean.functions import robust, text as tx, urls as ul
from postglean.operators import attachments as att, consistency as con, evidence as evd, fusion, headers as hd, markup
from postglean.plans import fixtures
from postglean.policy import Policy, load_policy
from postglean.sources import mail


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_text_functions(spark):
    row = one(
        spark,
        tx.normalize_text(F.lit(" ｈello​ wоrld \n x ")).alias("a"), tx.normalize_text(F.lit(None).cast("string")).alias("b"), tx.fold_confusables(F.lit("plain 0")).alias("c"),
        tx.tokens(F.lit("The quick_brown fox, 12 of THE-end")).alias("d"), tx.phrase_probability(F.lit("Please UPDATE your account")).alias("e"), tx.phrase_probability(F.lit(None).cast("string")).alias("f"),
        tx.entropy(F.lit("aabb")).alias("g"), tx.entropy(F.lit("")).alias("h"), tx.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("i"),
    )
    assert row.a == "hello world x" and row.b == "" and row.c == "plain 0"
    assert row.d == ["quick", "brown", "fox", "theend"] and row.e == 0.85 and row.f == 0.1
    assert row.g == 1.0 and row.h == 0.0 and row.i == 1.0


def test_hash_embedding_has_length_one(spark):
    v = one(spark, tx.hash_embedding(F.lit("verify your account")).alias("v")).v
    assert len(v) == 768 and math.isclose(sum(x * x for x in v), 1.0, rel_tol=1e-5)


def test_urls(spark):
    row = one(
        spark,
        ul.urls_in_text(F.lit("hxxp://evil[.]com/now and http://ok.example.com/x.")).alias("a"), ul.normalize_url(F.lit(" hxxps://a[.]b/50%+%41 ")).alias("b"),
        ul.host(F.lit("http://u@Evil.test:80/x")).alias("c"), ul.is_external(F.lit("http://a.x.test/"), F.lit("x.test")).alias("d"), ul.authority(F.lit("http://u@H.test:8#x/y")).alias("e"),
        ul.url_record(F.lit("http://evil.test/v"), F.lit("https://good.test")).alias("r"), ul.suspicion(F.expr("cast(null as array<struct<raw_url:string,domain:string,is_punycode:boolean,display_text_mismatch:boolean>>)")).alias("s"),
    )
    assert row.a[1] == "http://ok.example.com/x" and "p://evil[.]com/now" in row.a[0]
    assert row.b == "http://a.b/50%+A" and row.c == "evil.test" and row.d is False and row.e == "H.test:8#x"
    assert row.r.display_text_mismatch and row.r.tld == "test" and row.s == 0.0


def test_redirects_end(spark):
    links = spark.createDataFrame([("a",), ("z",)], "src string")
    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    got = {r.src: (r.target, r.hops) for r in ul.expand_redirects(links, hops, 5).collect()}
    assert got == {"a": ("c", 5), "z": ("z", 0)}


def test_robust(spark):
    xs = F.array(*[F.lit(float(x)) for x in (1, 2, 3, 100)])
    row = one(spark, robust.median(xs).alias("m"), robust.mad(xs, F.lit(2.5)).alias("d"), robust.median(F.array().cast("array<double>")).alias("z"), robust.hour_anomaly(F.lit(23.0), F.lit(1.0)).alias("h"), robust.novelty(F.lit(0), F.lit(5)).alias("n"))
    assert (row.m, row.d, row.z, row.n) == (2.5, 1.0, 0.0, 1.0) and math.isclose(row.h, 2 / 12)


def test_uncertainty_and_decision(spark):
    def report(values, p):
        d = fusion.disagreement(F.array(*[F.lit(float(v)) for v in values]))
        r = fusion.uncertainty_report(d, 4, F.lit(p))
        return one(spark, d.alias("d"), r["uncertainty"].alias("u"))

    assert round(report([0.90, 0.88, 0.92, 0.87], 0.92).d, 3) == 0.035
    assert report([0.95, 0.08, 0.10, 0.12], 0.95).d > 0.5
    assert report([0.5], 0.5).d == 0.0
    levels = one(spark, *[fusion.decide(F.lit(p), F.lit(u), Policy()).alias(n) for n, p, u in (("a", 0.9, 0.1), ("b", 0.9, 0.5), ("c", 0.7, 0.45), ("d", 0.5, 0.9), ("e", 0.1, 0.9))])
    assert tuple(levels) == ("BLOCK", "REVIEW", "REVIEW", "FLAG", "ALLOW")


def test_evidence_id_and_rank(spark):
    row = one(spark, evd.evidence_id(F.lit("URL"), F.lit("domain_age"), F.lit("2 days"), F.lit("url")).alias("i"), evd.rank_score(F.lit(0.9), F.lit("critical"), F.lit("high")).alias("r"), evd.severity(F.lit(0.4)).alias("s"))
    assert row.i == "9c311fd3d5136d83" and row.r == 0.9 and row.s == "medium"


def test_evidence_dedupe_keeps_the_strongest_at_the_first_place(spark):
    rows = spark.createDataFrame([(1, 0, "x", 0.2, 0.2, "f"), (1, 1, "x", 0.9, 0.9, "f"), (1, 2, "y", 0.5, 0.5, "g")], "uid int, seq int, evidence_id string, rank_score double, normalized_score double, feature string")
    got = sorted(tuple(r) for r in evd.deduplicate(rows, ["uid"]).select("seq", "evidence_id", "rank_score").collect())
    assert got == [(0, "x", 0.9), (2, "y", 0.5)]


def test_identity_of_lookalike(spark):
    rows = spark.createDataFrame([("Microsoft Support", "s@micros0ft.com"), ("Microsoft", "security@microsoft.com"), ("PayPal", "bounce@sendgrid.net"), (None, None)], "d string, a string")
    f = con.identity_features(Policy(), F.col("d"), F.lit(""), F.col("a"), F.lit(None).cast("string"))
    got = [r[0] for r in rows.select(f["brand_domain_mismatch"].alias("b")).collect()]
    assert got == [0.9, 0.0, 0.0, 0.0]


def test_files(spark):
    got = {r.filename: r for r in att.inspect_files(fixtures.files(spark)).collect()}
    kinds = {n: r.content.magic_type for n, r in got.items()}
    assert kinds["macro.docm"] == "docx" and kinds["table.xlsx"] == "xlsx" and kinds["bill.pdf"] == "zip" and kinds["empty.txt"] == "unknown"
    assert got["plain.pdf"].risk == 0 and got["lure.pdf"].risk >= 0.5 and got["macro.docm"].risk >= 0.6 and got["bill.pdf"].risk >= 0.7 and got["bomb.zip"].risk >= 0.7
    assert got["outer.zip"].features.nested_archive_count >= 1 and got["outer.zip"].features.archive_depth >= 2 and got["art.svg"].features.script_indicator == 1
    assert got["table.xlsx"].risk == 0 and got["noise.bin"].risk == 0
    agg = att.aggregate_files(att.inspect_files(fixtures.files(spark)), ["content_type"]).count()
    assert agg >= 5


def test_markup(spark):
    m = markup.measure('<body><form action="http://steal.test/x"><input type="password"></form><div style="display:none">Verify your account password</div><script>var t="</p>";eval(1)</script></body>', "a.test")
    assert m["credential_collection_indicator_count"] == 1 and m["hidden_text_length"] > 10 and m["script_count"] == 1 and "eval" in m["script_text"]
    assert markup.measure(None, None)["dom_node_count"] == 0 and markup.measure("<p>a<b>c", "")["visible_text"] == "a c"
    rows = spark.createDataFrame([("<div>" * 12 + "x",), (None,), ("",)], "h string").withColumn("m", markup.measures("h", F.lit("a.test")))
    r = rows.withColumn("s", markup.html_scores(F.col("m"), markup.script_features(F.col("m")), F.lit(0.0))).collect()
    assert r[0].m.dom_depth >= 11 and r[0].s.html_risk_score == 0 and r[1].s.html_risk_score == 0


def test_mail(spark):
    got = {r.name: r for r in mail.parse_messages(fixtures.raw_mail(spark)).collect()}
    assert got["plain"].from_addr == "ada@velmora.example" and got["plain"].spf_result == "fail" and got["plain"].dkim_result == "pass" and len(got["plain"].urls) == 2
    assert got["plain"].offset_minutes == 60 and got["html"].urls[0].raw_url == "http://one.test/a" and got["none"].subject == "" and not got["empty"].degraded


def test_header_rules(spark):
    r = one(spark, hd.header_anomalies(F.lit("a@x.com"), F.lit("<a@x.com>"), F.lit(None).cast("string"), F.lit("Support")).alias("h")).h
    assert r.from_return_mismatch and not r.from_reply_mismatch and r.display_name_suspicious


def test_policy_files(tmp_path):
    p = tmp_path / "p.json"
    p.write_text('{"block_threshold": 0.9}')
    assert load_policy(str(p)).block == 0.9 and load_policy(str(tmp_path / "no.json")).block == 0.85
    p.write_text("{broken")
    assert load_policy(str(p)).block == 0.85
