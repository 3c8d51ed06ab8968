"""Mixing: shares, caps, deviation of the schedule."""

import os

import pandas as pd
import pytest

from almanak.llm import encode
from almanak.llm import mix as mixing
from almanak.llm.mix import Mix, exact, n_ranges, pfair, schedule_range

pytestmark = pytest.mark.skipif(not os.path.exists(encode.TOKENIZERS), reason="no tokenizers here")
DOCS = "doc_id bigint, text string, source string, weight string, quota string"
TARGETS = "mix_no bigint, source string, weight double, max_repeats int, text string"


SHARES = [
    {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}, {"a": 0.5, "b": 0.4999, "c": 0.0001}, {"mail": 0.15, "drive": 0.25, "notes": 0.2, "chat": 0.4}, {"a": 1.0},
    {"mail": 0.4, "drive": 0.2, "calendar": 0.1, "notes": 0.1, "export": 0.1, "scan": 0.05, "list": 0.03, "chat": 0.02}, {"a": 2 / 3, "b": 1 / 3}, {f"s{k}": 1 / 37 for k in range(37)},
]


@pytest.mark.parametrize("shares", SHARES)
@pytest.mark.parametrize("blocks,slots", [(900, 50), (9_001, 4_096)])
def test_ranges_together_stay_within_one_block(monkeypatch, shares, blocks, slots):
    monkeypatch.setattr(mixing, "SLOTS", slots)
    whole = sum(shares.values())
    needed = {s: -(-int(blocks * w / whole * 10) // 10) or 1 for s, w in shares.items()}
    order = [x for k in range(n_ranges(shares, needed)) for x in schedule_range(shares, needed, k)]
    assert [k for *_, k in order] == list(range(sum(needed.values())))
    done = dict.fromkeys(shares, 0)
    for s, j, k in order:
        assert j == done[s]
        done[s] += 1
        if all(done[x] < needed[x] for x in shares):
            assert all(abs(done[x] - w / whole * (k + 1)) < 1 for x, w in shares.items())
    assert done == needed


def test_least_shares():
    shares = {"a": 1 - 1e-10, "b": 1e-10}
    needed = {"a": 150_000, "b": 1}
    order = [x for k in range(n_ranges(shares, needed)) for x in schedule_range(shares, needed, k)]
    assert [k for *_, k in order] == list(range(150_001)) and ("b", 0) in {(s, j) for s, j, _ in order}
    assert pfair({}, {}, {}) == [] and sum(exact(shares).values()) == 1


def test_schedule_holds_every_use(spark):
    names = {"a": 0.5, "b": 0.4999, "c": 0.0001}
    docs = [(n * 10 + k, "word " * (1 + n % 3), s, "", "") for n in range(900) for k, s in enumerate(names)]
    mix = Mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, s, w, 3, "") for s, w in names.items()], TARGETS), block=64)
    key = ["mix_no", "source", "doc_id", "pass"]
    assert sorted(map(tuple, mix.schedule().select(key).collect())) == sorted(map(tuple, mix.uses().select(key).collect()))


def test_shares_caps_and_schedule(spark):
    docs = [(n, "word " * (5 + n % 11), ["Mail", " mail", "notes", "scan"][n % 4], "x", "y") for n in range(400)] + [(900, None, "mail", "", ""), (901, "x", None, "", ""), (902, "", "notes", "", "")]
    targets = [(1, "MAIL ", 2.0, None, ""), (1, "notes", 1.0, 3, ""), (1, "fax", 1.0, 2, ""), (2, "scan", 0.0, 1, ""), (3, "scan", 50.0, 4, ""), (3, "notes", None, 4, ""), (4, "mail", -1.0, 2, ""), (None, "mail", 1.0, 1, ""), (5, "notes", 1.0, 0, "")]
    mix = Mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS), block=20)
    shares = {(r.mix_no, r.source): r for r in mix.shares().collect()}
    assert abs(shares[1, "mail"].actual_share - 2 / 3) < 0.02 and abs(shares[1, "notes"].actual_share - 1 / 3) < 0.02
    assert shares[1, "fax"].uses == 0 and shares[1, "fax"].target_share == 0.25 and shares[1, "mail"].target_share == 0.5
    assert shares[1, "mail"].most_repeats == 1 and shares[3, "scan"].actual_share == 1.0 and shares[3, "scan"].most_repeats == 4
    assert all(shares[k].uses == 0 for k in ((2, "scan"), (4, "mail"), (5, "notes"), (3, "notes")))
    rows = mix.schedule().collect()
    assert len(rows) == sum(r.uses for r in shares.values())
    assert len({(r.mix_no, r.doc_id, r["pass"]) for r in rows}) == len(rows)
    taken, total = {"mail": 0, "notes": 0}, 0
    largest = max(r.n_tokens for r in rows)
    for r in sorted((r for r in rows if r.mix_no == 1), key=lambda r: (r.slot, r.place)):
        taken[r.source] += r.n_tokens
        total += r.n_tokens
        assert abs(taken["mail"] - total * 2 / 3) <= max(20, largest) + 2 * largest


def test_deviation(spark):
    docs = [(n, "word " * (1 + n * 7 % 60), ["mail", "notes", "scan"][n % 3], "x", "y") for n in range(900)]
    targets = [(1, "mail", 0.6, None, ""), (1, "notes", 0.3, None, ""), (1, "scan", 0.1, 2, "")]
    mix = Mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS), block=100)
    rows = mix.schedule().collect()
    goal, worst = {s: w for _, s, w, *_ in targets}, dict.fromkeys(["mail", "notes", "scan"], 0)
    sizes = {}
    for r in rows:
        sizes.setdefault((r.slot, r.source), []).append(r.n_tokens)
    taken, total = dict.fromkeys(goal, 0), 0
    for (_, s), n in sorted(sizes.items()):
        for add in (0, sum(n)):
            taken[s] += add
            total += add
            worst[s] = max(worst[s], abs(taken[s] - goal[s] * total))
    found = {r.source: r for r in mix.deviation().collect()}
    assert {s: round(x, 3) for s, x in worst.items()} == {s: r.worst_tokens for s, r in found.items()}
    assert all(r.worst_blocks < 2 for r in found.values())


def test_nothing(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "mail", 1.0, 1, "")], TARGETS)
    assert Mix(docs, targets).schedule().collect() == [] and Mix(docs, targets).shares().collect()[0].uses == 0
    assert Mix(docs, targets.limit(0)).shares().collect() == []
