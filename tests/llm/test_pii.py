"""Personal data: spans of each kind, what is none, learning and masking."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanak.llm import pii, pii_labelers
from almanak.llm.pii_labelers import Labelers, levelled

PERSON = "struct<name: string, email: string, response: string>"
EVENTS = f"event_no bigint, description string, organizer {PERSON}, attendees array<{PERSON}>, tbl string, kind string"
PARTS = "part_no bigint, text string, row_no string, begin_at string"
FAMILY = frozenset(["lintcombe", "garrmere", "montouvret"])
LABELERS = Labelers(frozenset(pii.GIVEN_NAMES).__contains__, FAMILY.__contains__)

YES = [
    ("write to ann.lee+x@mail.example.org.", "email", "ann.lee+x@mail.example.org"), ("at bob [at] firm (dot) co (dot) uk now", "email", "bob [at] firm (dot) co (dot) uk"), ("carl at firm dot test", "email", "carl at firm dot test"),
    ("Tel: (020) 7946-0391.", "phone", "(020) 7946-0391"), ("ring +44 (0)20 7946 0967 soon", "phone", "+44 (0)20 7946 0967"), ("call 415.555.0122", "phone", "415.555.0122"), ("Rückruf 030/23125-480", "phone", "030/23125-480"),
    ("passport no. XX0768810,", "id_number", "XX0768810"), ("Steuer-ID 05 424 834 202", "id_number", "05 424 834 202"), ("DNI n.º 99392743Z.", "id_number", "99392743Z"), ("SSN 946-39-5124", "id_number", "946-39-5124"),
    ("to 16 Quarrel Avenue Apt 19, Harrowmouth, ZZ 00545.", "address", "16 Quarrel Avenue Apt 19, Harrowmouth, ZZ 00545"), ("nach Kaltbachstraße 104, 07811 Wiesbrunn.", "address", "Kaltbachstraße 104, 07811 Wiesbrunn"),
    ("au 177, rue des Tilleuls, 00789 Vaudelys.", "address", "177, rue des Tilleuls, 00789 Vaudelys"), ("en Avda. de los Pinares 36, bajo, 00466 Valdorada.", "address", "Avda. de los Pinares 36, bajo, 00466 Valdorada"), ("from 93 Hob Hill.", "address", "93 Hob Hill"),
    ("98 Fennel Drive\n> Saltmere, ZZ 00227", "address", "98 Fennel Drive\n> Saltmere, ZZ 00227"), ("met Ruth A. Lintcombe there", "name", "Ruth A. Lintcombe"), ("Lintcombe, Ruth said", "name", "Lintcombe, Ruth"), ("by J. Garrmere", "name", "J. Garrmere"),
    ("Hi Owen,", "name", "Owen"), ("in Owen’s office", "name", "Owen"), ("Frau Käthe Garrmere", "name", "Käthe Garrmere"), ("\\nRuth Lintcombe (x)", "name", "Ruth Lintcombe"), ("COLIN LINTCOMBE", "name", "COLIN LINTCOMBE"),
]
NO = ["Message-Id: <123.A@mx4.invalid>", "plan_v2@2x.png", "order 5439 695 6835 #4951957/8652", "Version 6.11.46 on 192.0.2.248", "map 57.8343, 11.2166", "The total came to €8112.22", "(XX-12345) INV-2026-651836", "Meet by Lower Quay, then", "Grace period ends on 2026-06-14", "April 14 is fine", "Rose bushes, hazel and ivy", "Mark the minutes as final", "Lintcombe Logistics Ltd", "page 8311 and 9432 lines"]


@pytest.mark.parametrize("text,kind,span", YES)
def test_proposals(text, kind, span):
    found = [(c.kind, text[c.begin : c.end]) for c in LABELERS.candidates(text) if sum(c.votes) > 0]
    assert (kind, span) in found


def test_kinds_propose_without_regard_to_each_other():
    spans = {(c.kind, c.begin, c.end) for c in LABELERS.candidates("Steuer-ID 05 424 834 202")}
    assert {("id_number", 10, 24), ("phone", 10, 24)} <= spans
    inside = [c for c in LABELERS.candidates("to 16 Ruth Garrmere Road, Harrowmouth, ZZ 00545") if c.kind == "name"]
    assert inside and all(c.votes[-1] == -1 for c in inside)


def test_of_overlapping_spans_the_greatest_sum_stays():
    c = lambda kind, a, b: pii_labelers.Candidate(kind, a, b, ())
    x = [(3.0, c("id_number", 0, 9)), (2.0, c("phone", 0, 9)), (2.0, c("name", 10, 20)), (2.5, c("name", 14, 24)), (1.0, c("name", 21, 24)), (-1.0, c("name", 30, 33)), (4.0, c("address", 40, 60)), (3.0, c("name", 40, 44))]
    assert [(y.kind, y.begin, y.end) for y in pii.best(x)] == [("id_number", 0, 9), ("name", 10, 20), ("name", 21, 24), ("address", 40, 60)]


def train(spark, n=60):
    rows = [(k, f"{text} And {no}.", ("Ruth Lintcombe", None, None), [("Owen Garrmere", None, None), None], "", "") for k, (text, no) in enumerate((YES[i % len(YES)][0], NO[i % len(NO)]) for i in range(n))]
    rows += [(1000, None, None, None, "", ""), (1001, "", ("Ruth Lintcombe", None, None), [("Owen Garrmere", None, None)], "", "")]
    parts = [(k, NO[k % len(NO)] + "\n" + YES[k % len(YES)][0], "", "") for k in range(n)] + [(2000, None, "", ""), (2001, "", "", ""), (2002, "word " * 60_000 + "Hi Owen,", "", "")]
    return spark.createDataFrame(rows, EVENTS), spark.createDataFrame(parts, PARTS)


def test_learned_detector(spark):
    events, parts = train(spark)
    detector = pii.train(events, parts)
    for text in NO:
        assert detector.spans(text) == [], text
    for text, kind, span in YES:
        assert (kind, span) in [(k, text[a:b]) for a, b, k in detector.spans(text)], text
    found = pii.found_spans(events, parts, detector).collect()
    assert any(r.tbl == "parts" and r.row_no == 2002 and r.begin_at == 300_003 for r in found) and not any(r.row_no in (1000, 1001, 2000, 2001) for r in found)
    df = spark.createDataFrame([("Hi Owen, write to a@b.example or 415.555.0122.",), (None,), ("",)], "text string")
    assert [r[0] for r in df.select(pii.masked(F.col("text"), detector)).collect()] == ["Hi [NAME], write to [EMAIL] or [PHONE].", None, ""]


def test_nothing(spark):
    events, parts = spark.createDataFrame([], EVENTS), spark.createDataFrame([], PARTS)
    assert pii.found_spans(events, parts).collect() == [] and pii.masked_texts(events, parts).collect() == []


def test_reliabilities_are_estimated_in_either_direction():
    rng = np.random.default_rng(1)
    truth = rng.random(6000) < 0.6
    right = lambda share: np.where(rng.random(6000) < share, truth, ~truth) * 2 - 1
    votes = np.stack([right(0.9), right(0.85), right(0.8), right(0.25), np.where(rng.random(6000) < 0.5, right(0.9), 0)], 1)
    p, weights, prior = pii.reliabilities(votes)
    assert abs(prior - 0.6) < 0.05 and weights[3, 1] < 0 < weights[3, 0] and (weights[[0, 1, 2, 4], 1] > 0).all()
    assert ((p > 0.5) == truth).mean() > ((votes.sum(1) > 0) == truth).mean() > 0.8


def invented(rng, n):
    """Names of no list anywhere: syllables, as the texts may hold any."""
    part = lambda k: "".join(rng.choice(list("bdfgklmnprstvz")) + rng.choice(list("aeiou")) for _ in range(k))
    return [part(3).capitalize() + rng.choice(["x", "lt", "rn", "sk"]) for _ in range(n)]


def test_family_names_that_no_gazetteer_holds():
    """Held out: the family names of these texts stand in no gazetteer and have no known form."""
    rng = np.random.default_rng(5)
    given = [g.capitalize() for g in pii.GIVEN_NAMES[:60]]
    known, unknown = invented(rng, 150), invented(rng, 150)
    forms = ["The minutes were signed by {} on Monday.", "Ask {} about the boiler.", "Frau {} brings the lease.", "{} said the pump is fine, the pump works.", "Send it to {}, please.", "With thanks, {}", "We met {} and the caretakers."]
    texts, names = [], []
    for k in range(1200):
        name = f"{rng.choice(given)} {rng.choice(known if k % 2 else unknown)}"
        texts.append(str(rng.choice(forms)).format(name) + str(rng.choice(["", " The bushes and the boiler were seen to.", " The committee met."])))
        names.append(name)
    detector = pii.Detector(family=[x.lower() for x in known])
    detector.learn(texts[:600])
    found = [any(t[a:b] == n for a, b, k in detector.spans(t) if k == "name") for t, n in zip(texts[600:], names[600:])]
    assert sum(found) >= 0.99 * len(found)
    plain = ["The Harbour Office was closed.", "Mark the Minutes as final.", "Rose Bushes and ivy", "In May the Boiler failed.", "Dear Committee, the lease is here."]
    assert [detector.spans(t) for t in plain] == [[]] * len(plain)


def test_the_classifier_decides(spark, data):
    """Neither the rule that no labeler may object nor the majority gives what the classifier gives."""
    events, parts = spark.read.parquet(f"{data}/vevents.parquet"), spark.read.parquet(f"{data}/parts.parquet")
    detector = pii.train(events, parts)
    texts = [r.text for r in pii.free_texts(events, parts).collect()]
    kept = {(t, *x) for t in texts for x in detector.spans(t)}
    every = [(t, c) for t in texts for c in detector.labelers.candidates(t)]
    assert len(kept ^ {(t, c.begin, c.end, c.kind) for t, c in every if min(c.votes) >= 0}) >= 2 and len(kept ^ {(t, c.begin, c.end, c.kind) for t, c in every if sum(c.votes) > 0}) >= 1


def test_gazetteer_holds_every_name_once_met(spark):
    events, _ = train(spark, 1)
    names = spark.createDataFrame([("g", f"name{k}") for k in range(3000)] + [("f", "other")], "kind string, name string")
    gazetteer = pii.Gazetteer(names.unionByName(pii.names_known(events)))
    assert all(gazetteer.holds("g", f"name{k}") for k in range(3000)) and gazetteer.holds("f", "garrmere") and gazetteer.holds("g", "ruth")
    assert not gazetteer.holds("g", "other") and sum(gazetteer.holds("f", f"name{k}") for k in range(3000)) == 0


def test_places_hold():
    text = "a<br>b &lt;c@d.example&gt;\\nRuth"
    assert len(levelled(text)) == len(text)


@pytest.mark.parametrize("text", ["Treffen: Berliner Ring 5", "Frankfurter Strasse 12", "Lindenweg\xa012", "Neuer Ort: Wiener Strasse\xa07b", "um 14:00 - 12 Rose Lane", "le 3/4, 10-11, 12 bis, rue de Lyon", "C.\xa0Mayor, 3"])
def test_screens_are_no_narrower_than_the_patterns(text):
    spans = [m.span() for p in (pii_labelers._ADDRESS_FIRST_NUMBER, *(p for p, _ in pii_labelers._ADDRESSES)) for m in p.finditer(text)]
    assert spans and {(c.begin, c.end) for c in Labelers(lambda w: False, lambda w: False).candidates(text) if c.kind == "address"} == set(spans)
