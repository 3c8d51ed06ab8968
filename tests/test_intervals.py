"""Periods and gaps against a plain sweep."""

from datetime import datetime

import numpy as np
import pytest

from almanak.operators.intervals import BUCKET_S, busy_periods, combine, periods_and_gaps

WHEN = "struct<kind: string, wall: timestamp_ntz, tz: string>"
EVENTS = f"event_no bigint, feed_no bigint, starts {WHEN}, ends {WHEN}, duration string, bucket string, b string, u string"


def sweep(spans):
    out = set()
    for feed in {s[0] for s in spans}:
        done = []
        for _, b, u in sorted(s for s in spans if s[0] == feed):
            if done and b <= done[-1][1]:
                done[-1][1] = max(done[-1][1], u)
            else:
                done.append([b, u])
        out |= {(feed, "period", b, u) for b, u in done} | {(feed, "gap", x[1], y[0]) for x, y in zip(done, done[1:])}
    return out


@pytest.mark.parametrize("seed,width", [(1, 50), (2, 400), (3, 3000)])
def test_equals_a_sweep_over_buckets(spark, seed, width):
    rng = np.random.default_rng(seed)
    spans = [(int(f), int(b), int(b + w)) for f, b, w in zip(rng.integers(0, 4, 600), rng.integers(-5000, 5000, 600), rng.integers(1, width, 600))]
    spans += [(9, 0, 10), (9, 10, 20), (9, 0, 10), (9, 2, 3), (9, 30, 4000)]
    got = periods_and_gaps(spark.createDataFrame(spans, "feed_no bigint, begin_s bigint, until_s bigint"), bucket_s=100).collect()
    assert {tuple(r) for r in got} == sweep(spans) and len(got) == len(set(got))


def test_merging_partial_lists_is_the_same_in_any_order():
    rng = np.random.default_rng(5)
    k, b = rng.integers(0, 3, 300), rng.integers(0, 1000, 300)
    u = b + rng.integers(1, 30, 300)
    whole = combine(k, k * 0, b, u)
    left, right = (combine(k[s], k[s] * 0, b[s], u[s]) for s in (slice(0, 111), slice(111, None)))
    merged = combine(*(np.concatenate(p) for p in zip(right, left)))
    assert all((x == y).all() for x, y in zip(whole, merged))
    assert len(combine(k[:0], k[:0], b[:0], u[:0])[0]) == 0
    far = combine(np.array([1, 2]), np.array([0, 0]), np.array([-(2**61), 5]), np.array([2**61, 6]))
    assert far[3].tolist() == [2**61, 6]


def test_what_an_event_covers(spark):
    t = lambda *a: datetime(*a)
    z = lambda w, tz="UTC", kind="utc": (kind, w, tz)
    rows = [
        (1, 1, z(t(2026, 1, 1, 9)), z(t(2026, 1, 1, 10)), "PT5H"),
        (2, 1, z(t(2026, 1, 1, 20)), z(t(2026, 1, 1, 19)), "PT30M"),
        (3, 1, z(t(2026, 1, 2)), None, "1 hour"),
        (4, 1, z(t(2026, 1, 3)), None, "-PT1H"),
        (5, 2, z(t(2026, 3, 28), "Europe/Berlin", "date"), None, "P2D"),
        (6, 3, z(t(2026, 3, 28, 12), "Europe/Berlin", "zoned"), None, "P1D"),
        (7, 4, z(t(2026, 3, 29), "Europe/Berlin", "date"), None, None),
        (8, None, z(t(2026, 1, 1)), None, "PT1H"),
        (9, 5, None, z(t(2026, 1, 1)), "PT1H"),
        (10, 6, z(t(2026, 10, 25, 2, 30), "Europe/Berlin", "zoned"), None, "PT1H"),
        (11, 7, z(t(2026, 3, 29, 2, 30), "Europe/Berlin", "zoned"), None, "PT1H"),
        (12, 8, z(t(2026, 1, 1), None), None, "PT1H"),
    ]
    got = {tuple(r) for r in busy_periods(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], EVENTS)).collect() if r.what == "period"}
    s = lambda *a: int((datetime(*a) - datetime(1970, 1, 1)).total_seconds())
    assert got == {
        (1, "period", s(2026, 1, 1, 9), s(2026, 1, 1, 10)), (1, "period", s(2026, 1, 1, 20), s(2026, 1, 1, 20, 30)),
        (2, "period", s(2026, 3, 27, 23), s(2026, 3, 29, 22)), (3, "period", s(2026, 3, 28, 11), s(2026, 3, 29, 11)), (4, "period", s(2026, 3, 28, 23), s(2026, 3, 29, 22)),
        (6, "period", s(2026, 10, 25, 0, 30), s(2026, 10, 25, 1, 30)), (7, "period", s(2026, 3, 29, 1, 30), s(2026, 3, 29, 2, 30)), (8, "period", s(2026, 1, 1), s(2026, 1, 1, 1)),
    }


def test_empty(spark):
    assert busy_periods(spark.createDataFrame([], EVENTS)).collect() == []
    assert BUCKET_S > 0
