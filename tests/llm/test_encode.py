"""Encoding: equal to one call of the tokenizer, also across chunks; decoding gives the text back."""

import os
import random

import pytest
from pyspark.sql import functions as F

from almanak.llm import encode

pytestmark = pytest.mark.skipif(not os.path.exists(encode.TOKENIZERS), reason="no tokenizers here")


def texts():
    r = random.Random(7)
    bits = ["word", " ", "  ", "\n\n", "\t", "don't", "1234", "…", "漢字", "é", "😀", "<|endoftext|>", "'s", " \xa0", "٣", "ﬁ", "-----"]
    mixed = ["".join(r.choice(bits) for _ in range(n)) for n in (1, 50, 2000, 30_000)]
    runs = [" " * 40_000, "a" * 40_000, "\n" * 17_000 + "x", ("ab1 " * 5000)[:20_000], "=" * 16_384 + " y" * 9000, "x" * encode.CHUNK, "x " * (encode.CHUNK // 2) + "z"]
    return ["", None, " ", "a", *mixed, *runs]


@pytest.mark.parametrize("spread,spread_chunk", [(1_000_000, 262_144), (10_000, 4_096)])
def test_equals_the_whole_text_encoded_at_once(spark, monkeypatch, spread, spread_chunk):
    monkeypatch.setattr(encode, "SPREAD", spread)
    monkeypatch.setattr(encode, "SPREAD_CHUNK", spread_chunk)
    rows = [(n, t, "ids", 3) for n, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, row int")
    got = {r.doc_id: list(r.ids) for r in encode.encode_corpus(df).collect()}
    whole = encode.encoding().encode_ordinary
    assert got == {n: whole(t or "") for n, t, *_ in rows}
    counts = {r.doc_id: r.n_tokens for r in encode.token_counts(df.select("doc_id", "text")).collect()}
    assert counts == {n: len(x) for n, x in got.items()}


@pytest.mark.parametrize("seed", range(4))
def test_stitches_are_boundaries_of_the_whole(monkeypatch, seed):
    monkeypatch.setattr(encode, "CHUNK", 64)
    monkeypatch.setattr(encode, "OVERLAP", 24)
    r = random.Random(seed)
    whole, n = encode.encoding().encode_ordinary, 0
    for _ in range(400):
        t = "".join(r.choice(["''", "'s", "'", "same", " ", "  ", "re", "12", "--", "\n", "a" * 30, " " * 40, "'" * 35, "漢"]) for _ in range(r.randrange(10, 150)))
        cuts = encode.stitches(t)
        assert set(cuts) <= set(encode.pre_token_starts(t).tolist()) and cuts == sorted(set(cuts))
        assert encode.encode_chunked(t, whole) == whole(t)
        n += len(cuts) - 1
    assert n > 1000


def test_round_trip_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "Zoë 😀 漢字\r\n"), (1, "Zoë 😀 漢字\r\n"), (2, None), (None, "x y " * 6000)], "doc_id bigint, text string")
    back = encode.encode_corpus(df).select("doc_id", encode.decode(F.col("ids")).alias("text")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == [(0, "x y " * 6000), (1, "Zoë 😀 漢字\r\n"), (1, "Zoë 😀 漢字\r\n"), (2, "")]
    assert encode.encode_corpus(df.limit(0)).collect() == []
