"""Shared spans against all windows of 180 code points."""

import random
from collections import defaultdict

import pytest

from almanak.llm import spans
from almanak.llm.spans import SPAN, SharedSpans, document_amounts, shared_amounts, shared_classes, shared_pairs, shared_spans

DOCS = "doc_id bigint, text string, t string, h string, pos string"


def brute(rows):
    where = defaultdict(set)
    for d, t in rows:
        for k in range(len(t or "") - SPAN + 1):
            where[t[k : k + SPAN]].add(d)
    pairs = {(a, b) for s in where.values() for a in s for b in s if a < b}
    shared = {}
    for d, t in rows:
        if t is not None and len(t) >= SPAN:
            covered = {k + i for k in range(len(t) - SPAN + 1) if len(where[t[k : k + SPAN]]) > 1 for i in range(SPAN)}
            shared[d] = len(covered)
    return pairs, shared


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_windows(spark, seed):
    r = random.Random(seed)
    noise = lambda n: "".join(r.choice("abcdefghij klmno漢字😀\n") for _ in range(n))
    passages = [noise(n) for n in (179, 180, 181, 200, 260, 420, 1500)]
    rows = []
    for d in range(40):
        rows.append((d, noise(r.randrange(0, 300)) + "".join(r.choice(passages) + noise(r.randrange(0, 120)) for _ in range(r.randrange(0, 3)))))
    rows += [(100, "a" * 500), (101, "b" * 180 + "a" * 180), (102, "-=" * 300), (103, "x" + "-=" * 90), (104, "a" * 179), (105, None), (106, ""), (107, rows[0][1]), (108, passages[6][3:1490])]
    rows += [(200 + k, passages[5] + "!") for k in range(6)]
    df = spark.createDataFrame([(*x, "", "", "") for x in rows], DOCS)
    pairs, shared = brute(rows)
    got = shared_pairs(df).collect()
    assert {tuple(p) for p in got} == pairs and len(got) == len(pairs)
    assert {x.doc_id: x.shared_chars for x in shared_amounts(df).collect()} == shared


def test_a_footer_in_every_document(spark):
    r = random.Random(8)
    noise = lambda n: "".join(r.choice("abcdefghij klmno\n") for _ in range(n))
    footer = noise(260)
    rows = [(d, noise(r.randrange(50, 300)) + footer) for d in range(60)] + [(100 + d, footer) for d in range(5)] + [(200, footer[:179]), (201, noise(400))]
    df = spark.createDataFrame([(*x, "", "", "") for x in rows], DOCS).repartition(5)
    pairs, _ = brute(rows)
    assert {tuple(p) for p in shared_pairs(df).collect()} == pairs
    found = {x.doc_id: (x.class_id, x.copies, x.links) for x in shared_classes(df).collect()}
    assert found == {d: (d, 0, 60) for d in range(60)} | {d: (100, 4, 60) for d in range(100, 105)} | {201: (201, 0, 0)}


def test_pairs_come_from_runs_and_hold_code_point_for_code_point(spark):
    r = random.Random(9)
    noise = lambda n: "".join(r.choice("abcdefgh 漢😀") for _ in range(n))
    passages = [noise(n) for n in (180, 240, 700)]
    texts = {d: noise(150) + r.choice(passages) + noise(90) for d in range(20)}
    members = SharedSpans(spark.createDataFrame([(d, t, "", "", "") for d, t in texts.items()], DOCS)).members().collect()
    assert members and all(len(m.span) == 4 * SPAN and sum(bytes(m.span).decode("utf-32-le") in t for t in texts.values()) > 1 for m in members)


def brute_spans(rows):
    """Per document, the spans that another holds whole and that no longer such span holds."""
    where = defaultdict(list)
    for d, t in rows:
        for k in range(len(t or "") - SPAN + 1):
            where[t[k : k + SPAN]].append((d, k))
    texts, out = dict(rows), set()
    for d, t in rows:
        reached = 0
        for k in range(len(t or "") - SPAN + 1):
            best = 0
            for o, j in where[t[k : k + SPAN]]:
                if o != d:
                    n = SPAN
                    while k + n < len(t) and t[k : k + n + 1] == texts[o][j : j + n + 1]:
                        n += 1
                    best = max(best, k + n)
            if best > reached:
                out.add((d, k, best))
                reached = best
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spans_equal_all_windows(spark, seed):
    r = random.Random(seed)
    noise = lambda n: "".join(r.choice("abcdefghij klmno漢字😀\n") for _ in range(n))
    passages = [noise(n) for n in (179, 180, 181, 200, 260, 420, 900)]
    cut = lambda p: p[r.randrange(0, len(p) // 2) :][: r.randrange(100, 900)]
    rows = [(d, noise(r.randrange(0, 200)) + "".join(r.choice([lambda p: p, cut])(r.choice(passages)) + noise(r.randrange(0, 60)) for _ in range(r.randrange(0, 4)))) for d in range(40)]
    # two passages that touch here and are apart elsewhere: shared twice, not once as a whole
    rows += [(60, "x" + passages[4] + passages[5] + "y"), (61, "1" + passages[4]), (62, passages[5] + "2")]
    rows += [(100, "a" * 300), (101, "b" * 180 + "a" * 190 + "c" * 200), (102, "-=" * 150), (103, "x" + "-=" * 95 + "b" * 181), (104, "a" * 179), (105, None), (106, ""), (107, rows[0][1] + passages[6]), (108, passages[6][3:890]), (109, "a" * 200 + "c" * 190), (110, "abc" * 99 + "d")]
    rows += [(200 + k, passages[5] + "!") for k in range(3)] + [(210, passages[4]), (211, passages[4]), (212, "short"), (213, "short")]
    df = spark.createDataFrame([(*x, "", "", "") for x in rows], DOCS)
    got = shared_spans(df).collect()
    assert {(x.doc_id, x.begin, x.end) for x in got} == brute_spans(rows) and len(got) == len({(x.doc_id, x.begin, x.end) for x in got})
    texts = dict(rows)
    assert len({(x.passage, texts[x.doc_id][x.begin : x.end]) for x in got}) == len({x.passage for x in got}) == len({texts[x.doc_id][x.begin : x.end] for x in got})
    _, shared = brute(rows)
    assert {x.doc_id: (x.n_chars, x.shared_chars) for x in document_amounts(df).collect()} == {d: (len(t or ""), shared.get(d, 0)) for d, t in rows}


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(spans, "CHUNK", 1000)
    r = random.Random(3)
    long = "".join(r.choice("abcdefgh ") for _ in range(6000))
    anchors = {(p, h) for h, p in zip(*[x.tolist() for x in (lambda a: (a[2], a[1]))(spans.anchors([spans.code_points(long)]))])}
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([1]), pa.array([long])], ["t", "doc_id", "text"])
    hashes = {h for b in spans._scan()(iter([batch])) for h in b.column("h").to_pylist()}
    assert {h - 2**64 if h >= 2**63 else h for _, h in anchors} <= hashes


def test_nothing(spark):
    assert shared_pairs(spark.createDataFrame([], DOCS)).collect() == [] and shared_amounts(spark.createDataFrame([], DOCS)).collect() == []


def test_texts_whose_hashes_agree_in_32_bits():
    import pyarrow as pa

    text = "".join(random.Random(4).choice("abcdefgh ") for _ in range(400))
    batch = pa.RecordBatch.from_arrays([pa.array([7, 7 + (5 << 32)]), pa.array([1, 2]), pa.array([text, text + "!"])], ["t", "doc_id", "text"])
    seen = defaultdict(set)
    for b in spans._scan()(iter([batch])):
        for h, t in zip(b.column("h").to_pylist(), b.column("t").to_pylist()):
            seen[h].add(t)
    assert {7, 7 + (5 << 32)} in seen.values()
