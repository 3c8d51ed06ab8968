"""Repeated deliveries against union-find, and the odd inputs."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from almanak.operators.components import components
from almanak.operators.deliveries import Segment, repeated_deliveries, without_repeats

SCHEMA = "delivery_no bigint, batch_no bigint, received_at timestamp, id string, copy_of struct<mid: string, from_addr: string, subject: string>, u string, key string"
START = datetime(2025, 1, 1, tzinfo=timezone.utc)


def brute(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    clean = lambda s: (s.replace("​", "").replace("­", "").strip() or None) if s is not None else None
    for no, _, _, i, c, *_ in rows:
        keys = [("i", clean(i))] if clean(i) else []
        if c is not None and clean(c[0]):
            keys.append(("c", *map(clean, c)))
        for k in keys:
            parent[find(("d", no))] = find(k)
    groups = {}
    for no in {r[0] for r in rows}:
        groups.setdefault(find(("d", no)), []).append(no)
    return {(min(g), n) for g in groups.values() for n in g if n != min(g)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_union_find(spark, seed):
    r = random.Random(seed)
    rows = []
    for n in range(400):
        i = r.choice([None, "", " ", f"id{r.randrange(150)}", f"\u00a0id{r.randrange(150)}\t", f"ID{r.randrange(9)}"])
        c = r.choice([None, (None, "a", "b"), (" ", "a", "b"), (f"m{r.randrange(120)}", r.choice(["a", None]), r.choice(["s", "s​", "t"]))])
        rows.append((n, n // 50, START + timedelta(days=r.randrange(200)), i, c, "x", "y"))
    got = repeated_deliveries(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {tuple(x) for x in got} == brute(rows) and len(got) == len(set(got))


def test_a_third_of_all_rows_is_one_message_and_chains_link(spark):
    rows = [(n, 0, START, "same" if n % 3 == 0 else f"i{n}", None, "", "") for n in range(900)]
    rows += [(1000 + k, 0, START, f"chain{k // 2}", (f"m{(k + 1) // 2}", "a", "b"), "", "") for k in range(60)]
    assert {tuple(x) for x in repeated_deliveries(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


def test_nothing_and_nulls(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repeated_deliveries(empty).collect() == [] and without_repeats(empty).collect() == []
    nulls = spark.createDataFrame([(1, None, None, None, None, None, None), (2, None, None, None, (None, None, None), None, None), (None, 1, START, "a", None, None, None), (3, 1, None, "a", None, None, None), (3, 1, None, "a", None, None, None)], SCHEMA)
    assert repeated_deliveries(nulls).collect() == []


def test_one_delivery_of_each_stays(spark):
    rows = [(1, 0, START, "a", None, "", ""), (2, 0, START, " a", None, "", ""), (3, 0, START, "A", None, "", "")]
    assert sorted(r.delivery_no for r in without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()) == [1, 3]


def test_filter_denies_no_key_and_storage_is_exact():
    rng = np.random.default_rng(4)
    h, g = np.sort(rng.integers(-(2**62), 2**62, 5000)), rng.integers(-(2**62), 2**62, 5000)
    s = Segment(h, g, np.arange(5000))
    found, owner = s.find(h, g)
    assert sorted(found) == list(range(5000)) and (np.sort(owner) == np.arange(5000)).all()
    assert len(s.find(h + 1, g)[0]) == 0


def test_components_of_long_chains(spark):
    edges = [(k + 1, k) for k in range(200)] + [(1001, 1000), (1003, 1001), (1003, 1002)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {k: 0 for k in range(1, 201)} | {1001: 1000, 1002: 1000, 1003: 1000}
