"""Event features, times, history, graph, store, campaigns, evaluation, streams on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from postglean.operators import campaigns, evaluation as ev, event_features as ef, graph, history, profiles, timestamps as ts
from postglean.plans import pipeline
from postglean.sources import store
from postglean.streaming import ingest

T = dt.datetime
DAY = dt.timedelta(days=1)


def test_sender_forms(spark):
    forms = ['"A b" <X.y@Z.test>', "mailto:a@b.test", '"office@o.test" <c@d.test>', "e@f.test (Name)", "\tg@h.test ", "<>", "undisclosed", "", None, '"L, F" <i+k@l.test>']
    got = [r[0] for r in spark.createDataFrame([(f,) for f in forms], "s string").select(ef.bare_address(F.col("s"))).collect()]
    assert got == ["x.y@z.test", "a@b.test", "c@d.test", "e@f.test", "g@h.test", None, None, None, None, "i+k@l.test"]


def events(spark):
    emails = spark.createDataFrame([(1, "m", "a@x.test", T(2025, 1, 1)), (1, "m", "A@X.test", T(2025, 1, 1)), (2, "m", "a@x.test", T(2025, 1, 2)), (3, "m", None, T(2025, 1, 3)), (4, "m", "b@x.test", None), (5, "m", "b@x.test", T(2025, 1, 5))], "uid bigint, mailbox string, sender string, received_at timestamp")
    verdicts = spark.createDataFrame(
        [(1, "m", 0.5, "flag ", '["r", "r", "s"]', T(2025, 2, 1)), (1, "m", 0.1, "ALLOW", "[]", T(2025, 1, 1)), (2, "m", 0.2, "FLAG", None, T(2025, 1, 1)), (2, "m", 0.9, None, '["z"]', T(2025, 3, 1)), (5, "m", 0.3, "FLAG", "not json", T(2025, 1, 1)), (9, "m", 1.0, "BLOCK", "[]", T(2025, 1, 1))],
        "uid bigint, mailbox string, score double, verdict string, reasons_json string, created_at timestamp",
    )
    verdicts = verdicts.withColumn("extra", F.lit(1))
    return ef.scored_events(emails, verdicts), verdicts


def test_feature_cells(spark):
    e, v = events(spark)
    types = ef.event_types(v)
    got = {(r.sender, r.verdict, r.reason): (r.n, r.last_uid) for r in ef.found_cells(e, types, 2).collect()}
    assert got == {("a@x.test", "FLAG", "r"): (1, 1), ("a@x.test", "FLAG", "s"): (1, 1), ("a@x.test", "FLAG", ""): (1, 2), ("b@x.test", "FLAG", ""): (1, 5)}
    wide = {r.sender: r for r in ef.feature_table(e, types, 2).collect()}
    k = types.index(("FLAG", "r"))
    assert wide["a@x.test"][f"n_{k}"] == 1 and wide["b@x.test"][f"n_{k}"] == 0 and wide["b@x.test"][f"last_{k}"] is None
    assert ef.found_cells(e.limit(0), []).count() == 0
    assert ef.event_types(v, 1) is None  # too many types for columns: they become keys
    keyed = {(r.sender, r.verdict, r.reason): (r.n, r.last_uid) for r in ef.found_cells(e, None).collect()}
    assert keyed == got


def test_times(spark):
    texts = {
        "2025-01-02T17:50:19.365": T(2025, 1, 2, 16, 50, 19, 365000), "Mon, 6 Jan 2025 18:15:34 -0500 (EST)": T(2025, 1, 6, 23, 15, 34), "05.02.25 08:04": T(2025, 2, 5, 7, 4), "1735971528206": T(2025, 1, 4, 6, 18, 48, 206000),
        "Jan 15, 2025 12:09:09 AM": T(2025, 1, 14, 23, 9, 9), "Tue Jan 14 13:12:47 2025": T(2025, 1, 14, 12, 12, 47), "20250119T171632Z": T(2025, 1, 19, 17, 16, 32), "19 Feb 25 03:55:10 +0545": T(2025, 2, 18, 22, 10, 10),
        "2025-03-30 02:30:00": None, "2025-10-26 02:30:00": None, "Tue, 31 Feb 2026 10:61:00 +0100": None, "0000-00-00 00:00:00": None, "yesterday": None, "": None, "99999999999999999": None,
    }
    rows = spark.createDataFrame([(t, "Europe/Berlin") for t in [*texts, None]], "text string, tz string")
    got = {r.text: r.at for r in ts.parse_times(rows, "text", "tz").select("text", F.timestamp_micros(F.get("readings", F.lit(0))["at"]).alias("at")).collect()}
    assert got == {**texts, None: None}


def test_slash_dates_follow_their_source(spark):
    relays = spark.createDataFrame([("d.test", "UTC", "dmy"), ("m.test", "UTC", "mdy")], "host string, tz string, date_order string")
    chain = ["from a by d.test; 05/06/2025 10:00:00", "from a by m.test; 06/05/2025 10:00:00", "no time", None, "by u.test; 2025-06-05 10:00:00"]
    m = spark.createDataFrame([(1, "x@y.test", "2025-06-05T09:59:00Z", chain), (2, None, None, None)], "msg_id bigint, from_addr string, received_at string, received_chain array<string>")
    r = {(x.msg_id, x.hop_no): x for x in ts.resolve_times(ts.time_entries(m, relays), relays).collect()}
    assert r[1, 1].at == r[1, 2].at == T(2025, 6, 5, 10) and r[1, 3].state == "undetermined" and r[1, 5].at is None and r[2, 0].at is None
    log = spark.createDataFrame([(7, 1, 1, T(2025, 6, 5, 10, 0, 0, 500)), (8, 1, 1, T(2025, 6, 5, 10, 0, 1))], "log_id bigint, msg_id bigint, hop_no bigint, logged_at timestamp")
    assert [x.log_id for x in ts.matching_log_rows(ts.resolve_times(ts.time_entries(m, relays), relays), log).collect()] == [7]


MESSAGE = "msg_id bigint, mailbox string, uid bigint, subject string, from_addr string, from_display string, reply_to string, return_path string, headers map<string,string>, spf_result string, dkim_result string, dmarc_result string, body_plain string, body_html string, visible_text string, urls array<struct<raw_url:string,normalized:string,domain:string,tld:string,is_punycode:boolean,display_text_mismatch:boolean,display_text:string,scheme:string>>, attachments array<struct<filename:string,content_type:string,size:bigint,has_macros:boolean>>, extracted_image_text string, extracted_qr_urls array<string>, recipients array<string>, cc array<string>, ingested_at timestamp"


def message(i, at, sender="a@x.test", body="Verify your identity now", display="Ada", to=("bo@y.test",), **other):
    row = {"msg_id": i, "mailbox": "m", "uid": i, "subject": "Weekly report", "from_addr": sender, "from_display": display, "reply_to": "", "return_path": "", "headers": {}, "spf_result": "pass", "dkim_result": "pass", "dmarc_result": "pass", "body_plain": body, "body_html": "", "visible_text": body, "urls": [], "attachments": [], "extracted_image_text": "", "extracted_qr_urls": [], "recipients": list(to), "cc": [], "ingested_at": at}
    return tuple((row | other).values())


def test_scores(spark):
    url = ("http://micros0ft-login.com/verify", "http://micros0ft-login.com/verify", "micros0ft-login.com", "com", False, True, "https://microsoft.com/verify", "http")
    none = tuple(x if k < 3 else None for k, x in enumerate((3, "m", 3, *[None] * 19)))
    rows = [message(1, T(2026, 1, 15, 10, 30), "support@micros0ft-login.com", "Verify your identity. Update your account now", "Microsoft Support", subject="Urgent: verify your identity immediately", urls=[url]), message(2, T(2026, 1, 15), body="Minutes of the meeting"), none]
    m = spark.createDataFrame(rows, MESSAGE)
    got = {r.msg_id: r for r in pipeline.score(m, registry=pipeline.default_registry(with_history=False)).collect()}
    assert got[1].score == pytest.approx(0.85) and got[1].level in ("REVIEW", "BLOCK") and "1. " in got[1].explanation and got[1].evidence[0].category == "CONSISTENCY"
    assert got[2].level == "ALLOW" and got[3].level == "ALLOW" and got[3].score == pytest.approx(0.1)
    r = pipeline.default_registry(False).register("html", pipeline.detect_html)
    assert list(r.detectors)[-1] == "html" and "html" not in r.unregister("html").detectors


def test_behaviour(spark):
    start = T(2026, 1, 1, 10, 30)
    rows = [message(i, start + i * DAY) for i in range(1, 9)] + [message(9, start + 9 * DAY, to=("new@y.test",)), message(10, start + 10 * DAY - dt.timedelta(hours=7)), message(11, start + 11 * DAY, display="IT Support"), message(12, start, sender="stranger@z.test")]
    obs = history.observations(spark.createDataFrame(rows, MESSAGE))
    got = {r.msg_id: r for r in history.summary(history.behaviour(obs)).collect()}
    assert got[8].sender_newness_score == pytest.approx(1 / (1 + 7 / 5)) and got[8].sender_frequency_anomaly == 0 and got[8].sender_time_anomaly < 0.2
    assert got[9].recipient_relationship_newness == 1 and got[10].sender_time_anomaly > 0.5 and got[11].display_name_history_anomaly == 1
    assert got[12].state == "genuinely_unknown" and got[12].sender_newness_score == 1
    assert {r.sender: r.messages for r in profiles.fold(None, obs).totals.collect()} == {"a@x.test": 11, "stranger@z.test": 1}


def test_graph_and_campaigns(spark):
    u = ("http://p.test/1", "http://p.test/1", "p.test", "test", False, False, "", "http")
    m = spark.createDataFrame([message(i, T(2026, 1, i), urls=[u], to=("bo@y.test", "cy@y.test")) for i in range(1, 4)], MESSAGE)
    e = graph.edges(m)
    assert e.where("type = 'SENT'").count() == 6 and graph.shared_hosts(e).first().messages == 3
    near = {r.id: r.distance for r in graph.ego(e.where("type = 'SENT'"), spark.createDataFrame([("bo@y.test",)], "id string")).collect()}
    assert near == {"bo@y.test": 0, "a@x.test": 1, "cy@y.test": 2}
    s = campaigns.signals(m)
    assert campaigns.membership(s, campaigns.campaign_table(s)).count() == 3 and campaigns.signals(m.limit(0)).count() == 0


def test_store(spark):
    old = spark.createDataFrame([(1, "a", 1, "x"), (2, "a", 1, "y")], "uid bigint, mailbox string, at int, v string")
    new = spark.createDataFrame([(2, "a", 2, "z"), (3, "a", 2, None)], "uid bigint, mailbox string, at int, v string")
    assert {(r.uid, r.v) for r in store.upsert(old, new).collect()} == {(1, "x"), (2, "z"), (3, None)}
    assert {(r.uid, r.v) for r in store.latest(old.unionByName(new), ["mailbox", "uid"], ["at"]).collect()} == {(1, "x"), (2, "z"), (3, None)}
    assert store.offsets(old).first().last_uid == 2 and {r.at for r in store.upsert_keeping(old, new, ["mailbox", "uid"], ["at"]).where("uid = 2").collect()} == {1}


def test_metrics(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 0), (0.1, 0), (None, 1)], "score double, label int")
    points = ev.curve(rows)
    assert ev.rates(points).where("threshold = 0.8").first().precision == 1.0 and ev.area(points).first().roc_auc == 1.0 and ev.cheapest(points, {"block": 0, "review": 0}).first().cost == 0
    parts = ev.split(spark.range(200).withColumn("g", F.col("id") % 20), "g")
    assert parts.groupBy("g").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0
    assert ev.disturbed(spark.createDataFrame([(1, "a b"), (2, None)], "id int, t string"), "t").count() == 2 * len(ev.MUTATIONS)


def test_stream_equals_batch(spark, tmp_path):
    m = spark.createDataFrame([message(i, T(2026, 1, i)) for i in range(1, 7)], MESSAGE)
    m.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.message_stream(spark, str(tmp_path / "in"), m, 1)
    for _ in range(2):  # started again, it reads nothing twice
        q = ingest.score_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), learn=True).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.uid, r.level, r.score) for r in ingest.written(spark, str(tmp_path / "out")).collect()}
    want = {(r.uid, r.level, r.score) for r in pipeline.score(m, registry=pipeline.default_registry(False)).collect()}
    assert got == want and len(got) == 6
    assert spark.read.parquet(str(tmp_path / "out" / "emails")).count() == 6 and ingest.learnt(spark, str(tmp_path / "out")).totals.first().messages == 6


def test_windows(spark):
    e = spark.createDataFrame([(1, T(2025, 1, 1, 1)), (1, T(2025, 1, 1, 2)), (1, T(2025, 1, 2, 1))], "user_id int, ts timestamp")
    assert sorted(r.n for r in ingest.tumbling(e, "ts", "1 day").collect()) == [1, 2] and ingest.sessions(e, "ts", "6 hours", "user_id").count() == 2 and ingest.sliding(e, "ts", "1 day", "12 hours").count() >= 3
