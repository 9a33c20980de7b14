"""Time blocks, profiles, detectors in isolation, sources and stores on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from postglean.functions import blocks
from postglean.operators import evaluation as ev, graph, history, profiles
from postglean.plans import fixture_queries as fq, fixtures
from postglean.policy import Policy
from postglean.session import met
from postglean.sources import imap, store
from postglean.streaming import velocity

DAY = dt.datetime(2026, 1, 1)


def test_blocks_change_nothing(spark):
    rows = [(i, i, "hot" if i % 3 else "cold", DAY + dt.timedelta(minutes=17 * (i // 2)), float(i % 7)) for i in range(240)] + [(900, 900, None, None, 1.0)]
    df = spark.createDataFrame(rows, "msg_id bigint, uid bigint, sender string, at timestamp, x double")
    order = ["at", "uid", "msg_id"]

    def state(size):
        r, cut = blocks.blocked(df, ["sender"], "at", size)
        r = blocks.running(r, ["sender"], order, {"n": F.lit(1), "s": F.col("x")}, {"last": F.col("at")}, cut)
        r = blocks.with_recent(r, ["sender"], order, 10, cut)
        w = __import__("pyspark").sql.Window.partitionBy("sender", "_block").orderBy(*order).rowsBetween(-10, -1)
        r = r.withColumn("xs", F.collect_list("x").over(w)).where("_own")
        return {x.msg_id: (x.n, x.s, x["last"], x.xs) for x in r.collect()}, cut

    (whole, no), (parts, yes) = state(1000), state(20)
    assert not no and yes and whole == parts and len(whole) == 241


def test_folds_add_up(spark):
    m = fixtures.messages(spark)
    obs = history.observations(m)
    more = [obs.withColumns({"msg_id": F.col("msg_id") + 10 * k, "at": F.col("at") + F.expr(f"interval {k} day")}) for k in range(4)]
    every = more[0].unionByName(more[1]).unionByName(more[2]).unionByName(more[3])
    once = profiles.fold(None, every)
    steps = None
    for part in more:
        steps = profiles.fold(steps, part)
    for name in ("totals", "counters"):
        a, b = ({tuple(str(v) for v in r) for r in getattr(p, name).select(*getattr(once, name).columns).collect()} for p in (once, steps))
        assert a == b and a
    assert {r.sender: r.display for r in profiles.derived(steps).collect()} == {"bo@evil.test": "paypal", "cy@kind.test": "cy", "": None}
    assert profiles.fold(None, obs.limit(0)).totals.count() == 0


def test_joins_are_sent_by_count_only(spark):
    a, b = spark.range(50).withColumnRenamed("id", "k"), spark.range(20).withColumnRenamed("id", "k")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(met(a, b, "k", limit=20)) and "SortMergeJoin" in plan(met(a, b, "k", limit=19)) and "SortMergeJoin" in plan(met(a, b, "k"))


@pytest.mark.parametrize("name", ["url03_normalize", "snk13_redirects", "htm02_counts", "con13_contradiction", "src11_policy", "str04_waits", "snk08_passwords", "att10_features", "udf02_degraded_rows"])
def test_fixture_queries_give_what_their_sql_states(spark, name):
    import duckdb

    got = fq.queries()[name](spark, "")
    columns = sorted(got.columns)
    want = duckdb.sql(fq.oracle_sql()[name]).select(*[f'"{c}"' for c in columns]).fetchall()
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want))


def test_learning_modes():
    with pytest.raises(ValueError):
        Policy(learn_from="sometimes")


def test_mail_reader_and_accounts():
    r = imap.MailReader({"mailboxes": "a@x.test,none@x.test"}, fixtures.Box)
    start, end = r.initialOffset(), r.latestOffset()
    assert end == {"a@x.test": 7, "none@x.test": 0}
    parts = r.partitions(start, end)
    assert [(m, u, bytes(b)) for p in parts for m, u, b in r.read(p)] == [("a@x.test", 3, b"ab"), ("a@x.test", 7, b"hello")] and r.partitions(end, end) == []
    assert imap.mailbox_list([]) == ["alice@demo.test", "bob@demo.test", "carol@demo.test"]


def test_isotonic_fit_never_falls(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.3, 0), (0.5, 1), (0.6, 0), (0.9, 1), (None, 1)], "score double, label int")
    fit = [r.calibrated for r in ev.isotonic(rows).orderBy("bin").collect()]
    assert fit == sorted(fit) and abs(fit[1] - 1 / 3) < 1e-9 and fit[0] == 0 and fit[-1] == 1
    assert ev.calibrated(rows, ev.isotonic(rows)).where("score = 0.9").first().calibrated == 1.0
    with pytest.raises(ValueError):
        ev.checked_split(spark.range(200).withColumn("t", F.lit("same")), "id", F.col("t"), 0.1)


def test_graph_and_velocity(spark):
    m = fixtures.messages(spark)
    v = {r.msg_id: r for r in velocity.velocities(m.unionByName(m.withColumn("msg_id", F.col("msg_id") + 10))).collect()}
    assert v[1].sender_1h == 2 and v[1].domain_720h == 2 and v[3].sender_720h == 0 and len(v) == 6
    e = graph.edges(m)
    judged = spark.createDataFrame([("message:1", 1), ("message:2", 0)], "message string, bad int")
    assert [(r.domain, r.messages, r.neighbour_reputation) for r in graph.infrastructure(e, judged).collect()] == [("domain:login.evil.test", 1, 0.75)]
    assert {r.label for r in graph.communities(e.where("type = 'SENT'")).collect()} and graph.communities(e.limit(0)).count() == 0


def test_store_reads(spark):
    e = spark.createDataFrame([("a", 1, "x the y"), ("a", 5, "the"), ("b", 2, None)], "mailbox string, uid bigint, subject string")
    assert store.latest_match(e, "the").first().uid == 5 and store.baseline(e, "a").first().last_uid == 5 and store.baseline(e.limit(0), "a").first().last_uid == 0
    old = spark.createDataFrame([(5, "moved")], "uid bigint, action_taken string")
    assert store.migrated(old, "audit_log", e).first().mailbox == "a" and store.migrated(old, "audit_log").first().mailbox is None
