"""Each text operator on small fixtures: true cases, near misses, nulls, empty tables, repeats, clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postglean.llm import abuse, garbled, leakage, lookalike, mixture, neardup, newtext, personal
from postglean.llm.boosting import SymmetricBoost


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_lookalikes(spark):
    watch = rows(spark, [(1, "display_name", "Caja Peñalar"), (2, "phrase", "scan the code"), (3, "phrase", "подтвердите"), (4, "phrase", None)], "watch_id bigint, kind string, watch_text string")
    m = rows(
        spark,
        [(1, "Caja Peñalar", "Ｓcan the code", "ѕсаn th​e code!"), (2, "Caja Peñalar", "scan the code", "ｓｃａｎ ｔｈｅ ｃｏｄｅ scan the code"), (3, "Caja Рeñаlar", "пoдтвердитe", "scan teh cоde"), (4, None, "", None), (5, "x Caja Рeñalar", "𝐬𝐜𝐚𝐧 𝐭𝐡𝐞 𝐜𝐨𝐝𝐞", "SСAN THE CODE")],
        "msg_id bigint, from_display string, subject string, body_plain string",
    ).withColumn("watch_id", F.lit(9))
    got = {tuple(r) for r in lookalike.disguised(m, watch).collect()}
    assert got == {(1, "body_plain", 2), (2, "from_display", 1), (3, "from_display", 1), (3, "subject", 3), (5, "subject", 2)}
    assert lookalike.disguised(m.limit(0), watch).count() == 0 and lookalike.disguised(m, watch.limit(0)).count() == 0
    clean = {r.msg_id: r for r in lookalike.canonical_fields(m).collect()}
    assert clean[2].from_display == "Caja Peñalar" and clean[4].from_display is None and clean[4].subject == "" and clean[5].subject == "scan the code"
    assert {tuple(r) for r in lookalike.disguised(m, watch, 1).collect()} == got  # watched texts in several blocks


def test_words_that_read_alike_become_equal():
    con = lookalike._connect()
    one = lambda x: con.execute("SELECT one_script(canonical(?))", [x]).fetchone()[0]
    for a, b in (("пoдтвердитe", "подтвердите"), ("Caja Рeñаlar", "Caja Peñalar"), ("сосо", "coco"), ("Aθήνα", "Αθήνα"), ("sсаn\u200b", "ｓcan")):
        assert one(a) == one(b)
    assert one("Новый график") == "Новый график" and one("plain text") == "plain text" and one(None) is None


PLAIN = """Hi Bo,

see the plan. On Monday Ada wrote that it is late.

Best regards,
Ada Lund
Team Lead, Norda Inc.
+34 900 349 417

PS: call me.

This message and its attachments are meant only for the addressee.

On Mon, 3 Mar 2025 at 10:00, Bo <bo@x.test>
wrote:

> Dear Ada,
>
> all done?

Yes, all done.

-----Original Message-----
From: Cy
Sent: 4 March 2025

old text"""


def test_new_text(spark):
    lines = PLAIN.split("\n")
    assert [lines[i - 1] for i in newtext.new_lines(PLAIN)] == ["Hi Bo,", "see the plan. On Monday Ada wrote that it is late.", "PS: call me.", "Yes, all done."]
    assert newtext.new_lines("") == [] and newtext.new_lines(" \n\t") == [] and newtext.new_lines("Von: A\nGesendet: 1.1.2025\n\nalt") == []
    html = "<p>Mine</p>\n<p>Am 01.02.2025 um 10:00 schrieb Bo:</p>\n<blockquote><p>Old</p>\n</blockquote><p>Reply</p>"
    assert newtext.new_lines("Mine\n Am 01.02.2025 um 10:00 schrieb Bo: \n Old \n Reply", html) == [1, 4]
    assert newtext.new_lines("Hallo,\n\nText.\n\nMit freundlichen GrÃ¼ÃŸen\nBo") == [1, 3]
    m = rows(spark, [(1, PLAIN, PLAIN, ""), (1, PLAIN, PLAIN, ""), (2, None, "", None)], "msg_id bigint, body_plain string, visible_text string, body_html string").withColumn("field", F.lit("x"))
    assert newtext.new_line_rows(m).count() == 16 and newtext.new_line_rows(m.limit(0)).count() == 0
    assert {(r.msg_id, r.new_text) for r in newtext.new_text(m).where("msg_id = 2").collect()} == {(2, None), (2, "")}


@pytest.mark.parametrize("size", [3, 8, 12, 30, 400])
def test_signatures_of_any_length(size):
    own = ["Hello,", "the plan is done.", ""]
    block = [f"Team {i}" if i % 2 else f"+49 30 555 {i:04d}" for i in range(size)]
    for start in ("--", "Best regards,"):
        assert newtext.new_lines("\n".join([*own, start, *block])) == [1, 2]
    assert newtext.new_lines("\n".join([*own, "Best regards,", "Ada", "", "Please call me when you have read this."])) == [1, 2, 7]


ORIGINALS = ["Schöne Grüße aus der Küche", "L’équipe a déjà payé 20 € – c’est réglé", "Новый график готов", "¿Dónde está la contraseña?"]


@pytest.mark.parametrize("text", ORIGINALS)
@pytest.mark.parametrize("code", ["cp1252", "cp850", "cp437", "mac_roman", "cp1251"])
def test_garbled_round_trip(text, code):
    bad = "".join(garbled._char(code, b) for b in text.encode())
    assert garbled.evidence(bad)[f"utf-8>{code}"] > 0 and garbled.evidence(text) == {}
    assert garbled.repair(bad, [f"utf-8>{code}"]) == text
    twice = "".join(garbled._char("cp1252", b) for b in bad.encode())
    if code == "cp1252":
        assert garbled.repair(twice, ["utf-8>cp1252"]) == text


def test_garbled(spark):
    good = [(i, "a@x.test", "TÂCHE ½ Preis, 20 €, MAÑANA: Zelda ©", "Really??? https://a.test/x?y=1") for i in range(1, 5)]
    bad = [(5, "a@x.test", "KÃ¼che", None), (6, None, "", "Bego├▒a"), (7, "b@y.test", "In�s", "Ïðîñèì ïðîâåðèòü"), (8, "b@y.test", "? ?????????? 71 ????? ??????", "ok")]
    m = rows(spark, good + bad, "msg_id bigint, from_addr string, subject string, body_plain string").withColumn("chain", F.lit(1))
    got = {(r.msg_id, r.field) for r in garbled.garbled(m).collect()}
    assert got == {(5, "subject"), (6, "body_plain"), (7, "subject"), (7, "body_plain"), (8, "subject")}
    fixed = {(r.msg_id, r.field): r.text for r in garbled.repaired(m).collect()}
    assert fixed[5, "subject"] == "Küche" and fixed[6, "body_plain"] == "Begoña" and fixed[7, "body_plain"] == "Просим проверить"
    assert garbled.garbled(m.limit(0)).count() == 0


def test_boosting_and_calibration():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    b = SymmetricBoost().fit(x[:1000], y[:1000]).calibrate(x[1000:], y[1000:])
    assert ((b.predict(x[1000:]) >= b.cut) == y[1000:]).mean() > 0.95
    assert SymmetricBoost().fit(x[:0], y[:0]).predict(x[:2]).shape == (2,)


GIVEN, START, END = ["Anna", "Boris", "Clara", "Dario", "Elsa", "Franz", "Greta", "Hugo"], ["Lund", "Vel", "Corv", "Drask", "Kell", "Ostr"], ["strom", "etti", "imov", "brook"]


def people(n):
    rnd = random.Random(3)
    for i in range(n):
        a, g = rnd.choice(START) + rnd.choice(END), rnd.choice(GIVEN)
        number, ident, order = f"+34 900 {rnd.randint(100, 999)} {rnd.randint(100, 999)}", f"{rnd.randint(100, 999)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}", rnd.choice([f"SN{rnd.randint(10**8, 10**9 - 1)}", f"2025-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}/{rnd.randint(1000, 9999)}", f"10.{rnd.randint(10, 250)}.{rnd.randint(10, 99)}.{rnd.randint(100, 250)}"])
        body = f"Dear {g},\n\nOrder {order} is open. You can reach {g} {a} on {number} or at {g.lower()}.{a.lower()}@x.test. Passport {ident} belongs to {a}, {g}. Send it to {i % 90 + 1} Larch Avenue, Kelburn 12345.\n\nBest,\n{g}"
        yield i, f"{g} {a}", f"{g.lower()}.{a.lower()}@x.test", body, None if i % 2 else f"call {g} {a} {number}"


def test_personal(spark):
    m = rows(spark, list(people(300)), "msg_id bigint, from_display string, from_addr string, body_plain string, extracted_image_text string").withColumn("kind", F.lit("x"))
    model = personal.fit(m)
    body = next(people(1))[3]
    found = [(personal.KINDS[k], body[s:e]) for s, e, k, _ in model.find([body])[0]]
    assert [k for k, _ in found] == ["PERSON", "PERSON", "PHONE", "EMAIL", "ID_NUMBER", "PERSON", "ADDRESS", "PERSON"]
    text = model.find([None, "", "write to ada (at) velmora (dot) example", "Order 2025-11-17/4169 ships. Order 10.200.35.211 is open, Wawa Inc."])
    assert text[0] == text[1] == text[3] == [] and text[2][0][2] == 0
    assert personal.redact("call +34 900 123 456 now", [(5, 20, 1, 1.0)]) == "call <PHONE> now" and personal.redact(None, []) is None
    got = personal.mentions(m, model)
    per = {r.kind: r["count"] for r in got.groupBy("kind").count().collect()}
    assert per["EMAIL"] == 300 and per["PHONE"] == 450 and per["ID_NUMBER"] == 300 and per["ADDRESS"] == 300 and per["PERSON"] >= 1300
    out = personal.redacted(m, model).first()
    assert "@" not in out.body_plain and personal.mentions(m.limit(0), model).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(30):
        base = rnd.sample(words, 60)
        for _ in range(3):
            texts.append(" ".join(rnd.choice(words) if rnd.random() < 0.04 * (g % 5) else w for w in base))
    texts += [texts[0], texts[0], "short text", None]
    m = rows(spark, [(i, None if i % 3 else "S", t) for i, t in enumerate(texts)], "msg_id bigint, subject string, body_plain string").withColumn("band", F.lit(1))
    sets = [neardup.words_of(None if i % 3 else "S", t) for i, t in enumerate(texts)]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if min(len(sets[i]), len(sets[j])) >= 25 and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.7}
    got = {tuple(r) for r in neardup.similar_pairs(m).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 40
    g = {r.msg_id: r for r in neardup.groups(m).collect()}
    assert g[0].group_id == g[90].group_id == g[91].group_id == 0 and 92 not in g
    assert all(g[i].group_id == g[j].group_id for i, j in got) and neardup.similar_pairs(m.limit(0)).count() == 0


def test_large_buckets_and_classes_are_cut_and_whole(spark):
    base = [f"b{i}" for i in range(30)]
    values = [(i, None, " ".join(base) + f" edit{i % 40}") for i in range(60)] + [(i, "s", " ".join(f"w{i // 4}x{k}" for k in range(30)) + f" z{i}") for i in range(60, 80)]
    values += [(7, None, values[7][2]), (None, "s", " ".join(base))]
    sets = {i: neardup.words_of(s, t) for i, s, t in values if i is not None}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    m = rows(spark, values, "msg_id bigint, subject string, body_plain string")
    for block in (1000, 7):
        assert {tuple(r) for r in neardup.similar_pairs(m, block=block).collect()} == want
        group = {r.msg_id: r.group_id for r in neardup.groups(m, block=block).collect()}
        assert {group[i] for i in range(60)} == {0} and all(group[i] == 60 + (i - 60) // 4 * 4 for i in range(60, 80))


def test_signature_of_a_text_in_pieces():
    text = {f"x{i}" for i in range(700)}
    whole, pieces = neardup.SuperMinHash(64).signatures([text]), neardup.SuperMinHash(64, cached=100).signatures([text, {"a"}])
    assert (whole[0][0] == pieces[0][0]).all() and (whole[1][0] == pieces[1][0]).all()


def test_no_join_of_near_duplicates_is_broadcast(spark):
    m = rows(spark, [(i, "s", " ".join(f"w{i // 2}x{k}" for k in range(30))) for i in range(20)], "msg_id bigint, subject string, body_plain string")
    plans = [neardup.similar_pairs(m), neardup.groups(m)]
    assert all("BroadcastHashJoin" not in p._jdf.queryExecution().executedPlan().toString() for p in plans)


def test_signatures_estimate_similarity():
    a, b = {f"x{i}" for i in range(300)}, {f"x{i}" for i in range(100, 400)}
    s, _ = neardup.SuperMinHash(2000).signatures([a, b])
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.04


def test_components(spark):
    chain = rows(spark, [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102)], "a bigint, b bigint")
    got = {r.id: r.root for r in neardup.components(chain).collect()}
    assert {got[i] for i in range(2, 41)} == {1} and got[102] == got[101] == 100


def test_leakage_equals_brute_force(spark):
    rnd = random.Random(2)
    vocab = [f"t{i}" for i in range(60)]
    items = [" ".join(rnd.choice(vocab) for _ in range(20)) for _ in range(8)] + ["too short item"]
    docs = []
    for i in range(60):
        w = [rnd.choice(vocab) for _ in range(80)]
        if i % 3 == 0:
            it = items[i % 8].split()
            k, n = rnd.randint(0, 8), rnd.choice([11, 12])
            w[10:10] = it[k : k + n]
        docs.append((i, ", ".join(w).upper() if i % 2 else "\n".join(w)))
    docs += [(60, None), (61, ""), docs[0]]
    d = rows(spark, docs, "doc_id bigint, text string").withColumn("term", F.lit("x"))
    t = rows(spark, list(enumerate(items)) + [(99, None)], "item_id bigint, item_text string")
    grams = lambda s: {tuple(s[i : i + 12]) for i in range(len(s) - 11)}
    own = [(i, x.lower().replace(",", " ").split()) for i, x in docs if x]
    want = {(i, j) for i, w in own for j, it in enumerate(items) if grams(w) & grams(it.split())}
    got = {(r.doc_id, r.item_id) for r in leakage.matches(d, t).collect()}
    assert got == want and want and leakage.matches(d.limit(0), t).count() == 0 and leakage.matches(d, t.limit(0)).count() == 0


def test_rake_meets_margins():
    rng = np.random.default_rng(4)
    cells = rng.integers(1, 100, (4, 3, 2)).astype(float)
    goal = [np.array([0.4, 0.3, 0.2, 0.1]) * 300, cells.sum((0, 2)) / cells.sum() * 300, cells.sum((0, 1)) / cells.sum() * 300]
    w = mixture.rake(cells, goal, np.full(4, 50.0))
    for k in range(3):
        assert np.allclose((cells * w).sum(tuple(a for a in range(3) if a != k)), goal[k], rtol=1e-4)


def test_mixture(spark):
    docs = [(i, ("alpha beta " * (5 + i % 7)).strip(), "en" if i % 3 else "DE", "big" if i % 4 else "small") for i in range(400)] + [(900, None, None, "big"), (901, "", "en", None)]
    d = rows(spark, docs, "doc_id bigint, text string, lang string, source string").withColumn("tokens", F.lit(1))
    t = rows(spark, [("big", 0.4, 1), ("small", 0.6, 3), ("absent", 0.2, 5)], "source string, target_share double, max_repeats bigint")
    got = {r.source: r for r in mixture.shares(mixture.mixture(d, t), t).collect()}
    assert abs(got["big"].actual_share - 0.4) < 0.02 and abs(got["small"].actual_share - 0.6) < 0.02 and got["absent"].taken_tokens == 0
    assert got["big"].most_copies <= 1 and got["small"].most_copies <= 3 and mixture.mixture(d.limit(0), t).count() == 0


def test_abuse_held_out(spark):
    rnd = random.Random(8)
    calm = ["The report is late again.", "Please close the ticket by Monday.", "Version two changes the portal.", "We archive every ledger.", "The filter now quarantines the word “fool” in mail.", "A session on harassment starts soon."]
    foul = ["You are a fool and everybody knows it.", "Get lost you useless fool.", "These people are vermin and must leave.", "Shut your mouth, y-o-u  f00l, or else."]
    docs, labels = [], []
    for i in range(900):
        bad = i % 12 == 0
        own = [rnd.choice(calm) for _ in range(6)] + ([rnd.choice(foul)] if bad else [])
        rnd.shuffle(own)
        docs.append((i, " ".join(own), "s" if i % 2 else None))
        if i % 2 == 0 or bad:
            labels.append((i, int(bad), "r"))
    d = rows(spark, docs + [(5000, None, "s"), (5001, "", "s")], "doc_id bigint, text string, source string").withColumn("score", F.lit(1))
    s = abuse.fit(d, rows(spark, labels, "doc_id bigint, abusive bigint, rater string"))
    got = {r.doc_id: r for r in abuse.scored(d, s).collect()}
    hit = {i for i, r in got.items() if r.abusive}
    want = {i for i in range(900) if i % 12 == 0}
    assert len(hit & want) >= 0.9 * len(want) and len(hit - want) <= 0.1 * len(want) and got[5000].score == 0 and got[5001].score == 0
    assert abuse.rates(d, s).count() == 2
    none = abuse.fit(d, rows(spark, [], "doc_id bigint, abusive bigint, rater string"))
    assert abuse.scored(d, none).where("abusive").count() == 0 and abuse.scored(d.limit(0), s).count() == 0


def test_class_prior_and_quotations():
    rng = np.random.default_rng(0)
    p = rng.normal(3, 1, 2000)
    u = np.concatenate([rng.normal(3, 1, 200), rng.normal(-2, 1, 1800)])
    assert abs(abuse.class_prior(p, u) - 0.1) < 0.02
    assert abuse.sentences("He wrote “You fool. Go away.” to us. Then left.") == ["He wrote “You fool. Go away.”", "to us.", "Then left."]
    assert abuse.sentences("“Never closed. Next one. " * 40)[:2] == ["“Never closed.", "Next one."]
    assert abuse.words("> f00l y*u") == [">", "fool", "y*"]
    s = abuse.Scorer({"fool": 2.0, "you fool": 1.0}, -1.0, 0.5, 0.1, {})
    assert abs(s.score("You fool! You fool you fool.") - 1 / (1 + np.exp(-(3 / 2**0.5 - 1)))) < 1e-9 and s.score(None) == s.score("") == 0


def test_mixture_with_language_targets(spark):
    d = rows(spark, [(i, "alpha beta " * 5, ("en", "de")[i % 4 == 0], ("a", "b")[i % 3 == 0]) for i in range(2000)], "doc_id bigint, text string, lang string, source string")
    t = rows(spark, [("a", 0.5, 4), ("b", 0.3, 4), ("none", 0.2, 1)], "source string, target_share double, max_repeats bigint")
    taken = mixture.mixture(d, t, total_tokens=8000.0, languages={"en": 0.5, "de": 0.5})
    got = {r.source: r for r in mixture.shares(taken, t).collect()}
    assert abs(got["a"].actual_share - 0.625) < 0.02 and abs(got["a"].wanted_share - 0.625) < 1e-9 and not got["none"].reachable
    lang = {r.lang: r.n for r in taken.join(d.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n")).collect()}
    assert abs(lang["de"] / (lang["de"] + lang["en"]) - 0.5) < 0.03


def test_only_addresses_are_mail(spark):
    model = personal.fit(rows(spark, list(people(300)), "msg_id bigint, from_display string, from_addr string, body_plain string, extracted_image_text string"))
    near = ["We took 12 @ 4.50 each.", "use lodash@4.17.21 now", "the price at that point is high", "arrived at this point we stop"]
    assert not any(k == 0 for found in model.find(near) for _, _, k, _ in found)
    assert all([k for _, _, k, _ in f] == [0] for f in model.find(["bo@other.test", "bo (at) other (dot) test", "bo at other dot test"]))
    held, share, alone, trees = model.figures["EMAIL"]
    assert held > 20 and 0 < share < 1 and trees >= alone


def test_abuse_samples_reach_their_bounds(spark):
    d = rows(spark, [(i, "You fool." if i % 20 == 0 else "All is well.", "s") for i in range(3000)], "doc_id bigint, text string, source string")
    labels = rows(spark, [(i, int(i % 20 == 0), "r") for i in range(3000)] + [(1, 0, "r")] * 3000, "doc_id bigint, abusive bigint, rater string")
    assert {k: v for k, v in abuse.fit(d, labels, 60, 200, 300).size.items() if k != "rounds"} == {"positive": 60, "unlabelled": 200, "rated": 300}
    few = abuse.fit(d, labels, 1000, 200, 300).size
    assert few["positive"] == d.where("doc_id % 20 = 0").where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(10)) >= 3).count()


def test_abuse_fits_all_rows(spark):
    text = lambda i: f"You fool, leave {'it' if i % 3 else 'now'}." if i % 2 == 0 else "All is well. The report is late." if i % 7 else "He wrote fool once."
    d = rows(spark, [(i, text(i), "s") for i in range(12_500)] + [(20_000, None, "s")], "doc_id bigint, text string, source string")
    labels = rows(spark, [(i, int(i % 2 == 0), "r") for i in range(12_500)], "doc_id bigint, abusive bigint, rater string")
    held = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(10)) < 3
    want = {"positive": labels.where(~held & (F.col("abusive") == 1)).count(), "unlabelled": 12_500, "rated": labels.where(held).count()}
    assert want["positive"] > 3_000 and want["rated"] > 3_000
    on_driver = abuse.fit(d, labels)
    assert {k: v for k, v in on_driver.size.items() if k != "rounds"} == want
    in_tasks = abuse.fit(d, labels, near=0)
    assert (in_tasks.bias, in_tasks.cut, in_tasks.prior, in_tasks.size) == (on_driver.bias, on_driver.cut, on_driver.prior, on_driver.size)
    assert np.array_equal(in_tasks.weights, on_driver.weights)
    a, b = (abuse.scored(x, in_tasks).collect() for x in (d, abuse.read(d)))
    assert sorted(a) == sorted(b) and {r.doc_id for r in a if r.abusive} == set(range(0, 12_500, 2))


def test_abuse_counts_terms_once_a_document(spark):
    texts = ["a b. a b c", "c a", None, "", "b b a", "zz c"]
    read = abuse.read(rows(spark, [(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string"))
    got = dict(zip(*(x.tolist() for x in abuse._counted(read.where("words is not null").withColumn("part", F.when(F.col("doc_id") < 1, 0).otherwise(1)))[:2])))
    one = {w: abuse.hashed(w) for w in "abc"}
    assert got == {one["a"]: 1, one["c"]: 1}
    assert abuse.best_cut(np.array([-3000, -2000]), np.array([5, 1]), np.array([1000, 2000]), np.array([2, 2])) == (abuse._sigmoid(1.0) + abuse._sigmoid(-2.0)) / 2


def test_names_of_all_messages(spark):
    hot = [(i, "News", "news@x.test", None, None) for i in range(40_000)]
    rare = [(40_000 + i, "Ottilie Marwick", "ottilie.marwick@x.test", "Dear Ottilie,\n\nok", None) for i in range(2)]
    m = rows(spark, hot + rare + [(i + 50_000, *p[1:]) for i, p in enumerate(people(300))], "msg_id bigint, from_display string, from_addr string, body_plain string, extracted_image_text string")
    names = personal.learn_names(m, m.count())
    assert names.given["ottilie"] == 2 and names.family["marwick"] == 2 and "news" not in names.given
    with pytest.raises(ValueError):
        personal.learn_names(m, 1, 3)


def test_greeting_and_closing_propose_unknown_names(spark):
    model = personal.fit(rows(spark, list(people(300)), "msg_id bigint, from_display string, from_addr string, body_plain string, extracted_image_text string"))
    found = model.find(["Dear Zbigniewa,\n\nall is well.\n\nBest regards,\nXanthippe", "Dear Customers,\n\nall is Well.\n\nRegards\nTeam"])
    assert [(s, e, k) for s, e, k, _ in found[0]] == [(5, 14, 4), (45, 54, 4)] and found[1] == []


def test_dates_are_no_addresses(spark):
    model = personal.fit(rows(spark, list(people(300)), "msg_id bigint, from_display string, from_addr string, body_plain string, extracted_image_text string"))
    boost = model.boosts[3]
    assert boost.scale != 1 or boost.shift != 0  # calibrated, so fitted on both labels
    dates = ["Im Januar 2025 war es kalt.", "Wir kommen Am Montag 12 Leute stark.", "In der Woche 12", "Im Quartal 3 neu"]
    assert not any(k == 3 for found in model.find(dates) for _, _, k, _ in found)
    true = ["Bitte an Am alten Speicher 71, 63496 Kelburn schicken", "Am alten Speicher 12", "Send it to 17 Larch Avenue please", "12 March Street, Kelburn 12345", "Mühlweg 29, 79697 Tarnholm"]
    assert [[k for _, _, k, _ in found if k == 3] for found in model.find(true)] == [[3]] * len(true)


def test_fold_decides_by_line_and_word():
    real, start = "Новый график готов\n", "Dear Ada,\nall is well here.\n"
    for head in (real * 150, "12 345 678\n" * 250, "A B C D\n" * 300, "\n" * 2500):
        assert personal.fold(head + "write to Аnnа Lund, аnnа@x.test") == head + "write to Anna Lund, anna@x.test"
    assert personal.fold(start * 90 + real * 200) == start * 90 + real * 200
    assert personal.fold("пишите на аnnа@x.test сегодня") == "пишите на anna@x.test сегодня"
    assert personal.fold(start + "Аса") == start + "Aca" and len(personal.fold(start + real)) == len(start + real)


def test_near_leakage(spark):
    rnd = random.Random(4)
    item = [f"t{i}" for i in range(30)]
    noise = lambda n: [f"n{rnd.randint(0, 200)}" for _ in range(n)]
    replaced = [("x" if i % 11 == 5 else w) for i, w in enumerate(item)]
    inserted = [v for i, w in enumerate(item) for v in ([w, "x"] if i % 11 == 5 else [w])]
    sparse = [("x" if i % 3 == 1 else w) for i, w in enumerate(item)]
    shuffled = rnd.sample(item, 30)
    docs = [(i, " ".join(noise(20) + w + noise(20))) for i, w in enumerate((item, replaced, inserted, sparse, shuffled, []))] + [(9, None)]
    d = rows(spark, docs, "doc_id bigint, text string")
    t = rows(spark, [(1, " ".join(item)), (2, "too short")], "item_id bigint, item_text string")
    got = {r.doc_id: r for r in leakage.all_matches(d, t).collect()}
    assert {i: r.kind for i, r in got.items()} == {0: "exact", 1: "near", 2: "near"}
    assert got[0].longest_run == 30 and got[0].best_window == 10 and got[1].best_window >= 7 and got[1].item_words == 30
    assert leakage.all_matches(d.limit(0), t).count() == 0
