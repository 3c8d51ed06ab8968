"""Encoding of a corpus with a public byte-level tokenizer, and decoding (problem 7).

Every text goes through the same operator: it is cut into overlapping chunks
(one, if it is that short); chunks are pre-tokenised by themselves near their
ends, two neighbours are stitched at the first place in their overlap where both
have a pre-token boundary, for from there on they agree; the pieces between the
stitches are encoded and their ids joined in order. The chunks of a text stay in
its task, except of very long texts, whose chunks and pieces go to many tasks.
Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
#: Code points of a chunk, and of its overlap with each neighbour.
CHUNK, OVERLAP = 2_048, 128
#: Texts of more code points are spread: their chunks, of so many code points, go to different tasks.
SPREAD, SPREAD_CHUNK = 1_000_000, 262_144
#: Code points encoded before a batch goes out.
STEP = 1_000_000
# Fixed value: the pre-token pattern of the tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[str, object] = {}


def encoding(name: str = TOKENIZER, folder: str = TOKENIZERS):
    """The tokenizer, loaded once a worker."""
    path = os.path.join(folder, f"{name}.tiktoken")
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def pre_token_starts(text: str) -> np.ndarray:
    """Where the pre-tokens of a text begin."""
    if "pattern" not in _loaded:
        import regex

        _loaded["pattern"] = regex.compile(PATTERN)
    return np.fromiter((m.start() for m in _loaded["pattern"].finditer(text)), np.int64)


def boundaries(text: str, begin: int, end: int) -> np.ndarray:
    """Pre-token boundaries that a reader finds who begins at ``begin``, as places in the whole text.

    One who begins within a pre-token may read it and the next one wrongly
    (the end of a run of quotation marks and a letter look like an elision),
    so the boundaries before the third one are left out. So are those after
    white space, for how that is parted depends on what follows it.
    """
    part = text[begin:end]
    starts = pre_token_starts(part)[2 if begin else 0 :]
    return starts[[not (k and part[k - 1].isspace()) for k in starts.tolist()]] + begin if len(starts) else starts


def stitch(text: str, middle: int) -> int | None:
    """The first boundary about ``middle`` that two neighbouring chunks both have; none, as within a long run, if they have none.

    Each chunk reaches OVERLAP beyond the middle. Of the left one only the end
    is read, from somewhat before the overlap on, of the right one the begin.
    """
    begin, end = max(0, middle - OVERLAP), middle + OVERLAP
    left, right = boundaries(text, max(0, begin - OVERLAP), end), boundaries(text, begin, end)
    both = np.intersect1d(left[left >= begin], right, assume_unique=True)
    return int(both[0]) if len(both) else None


def stitches(text: str, chunk: int | None = None) -> list[int]:
    """Where the pieces of a text begin: at 0 and where neighbouring chunks are stitched. Without a stitch the right chunk goes on the piece before."""
    chunk = chunk or CHUNK
    return [0, *(x for middle in range(chunk, len(text), chunk) if (x := stitch(text, middle)) is not None)]


def encode_chunked(text: str, encode: Callable[[str], list[int]]) -> list[int]:
    """The ids of a text by its pieces."""
    if len(text) <= CHUNK:
        return encode(text)  # one chunk, nothing to stitch
    cuts = stitches(text)
    out: list[int] = []
    for a, b in zip(cuts, [*cuts[1:], len(text)]):
        out += encode(text[a:b])
    return out


def _encoder(key: str, name: str, folder: str, counts_only: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: columns but ``text`` stay, ``ids`` (or their number) comes. Null gives no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(name, folder).encode_ordinary
        for batch in batches:
            rest = batch.drop_columns(["text"])
            texts, begin, size, ids = batch.column("text"), 0, 0, []
            for i, text in enumerate(texts):
                t = text.as_py() or ""
                ids.append(np.array(encode_chunked(t, encode), np.int32))
                size += len(t)
                if size >= STEP or i == len(texts) - 1:
                    lengths = np.array([len(x) for x in ids], np.int32)
                    if counts_only:
                        column = pa.array(lengths.astype(np.int64))
                    else:
                        column = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(np.concatenate(ids)))
                    part = rest.slice(begin, len(ids))
                    yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, key])
                    begin, size, ids = i + 1, 0, []

    return run


def _boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the boundaries of a chunk in its overlaps with the one before and the one after, as places in the whole text."""
    for batch in batches:
        left, right = [], []
        for text, at, c in zip(batch.column("text"), batch.column("at").to_pylist(), batch.column("chunk").to_pylist()):
            t, middle = text.as_py(), (c + 1) * SPREAD_CHUNK
            begin = max(0, middle - 2 * OVERLAP - at)
            # a chunk that begins within the text is read from its own begin, whose first boundaries are left out too
            found = boundaries(t, 0, 2 * OVERLAP)[0 if c == 0 else 2 :] + at
            left.append(found[found >= c * SPREAD_CHUNK - OVERLAP].tolist() if c else [])
            right.append([x for x in (boundaries(t, begin, len(t)) + at).tolist() if x >= middle - OVERLAP])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(left, pa.list_(pa.int64())), pa.array(right, pa.list_(pa.int64()))], [*batch.schema.names, "left", "right"])


def pieces_of_long_texts(long: DataFrame) -> DataFrame:
    """``row``, ``doc_id``, ``piece``, ``text``: pieces that begin at pre-token boundaries, in order, of texts (``row``, ``doc_id``, ``text``)."""
    chunks = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / SPREAD_CHUNK).cast("int"))
    c = long.select("row", "doc_id", "text", F.explode(chunks).alias("chunk"))
    at = F.greatest(F.lit(0), F.col("chunk") * SPREAD_CHUNK - OVERLAP)
    c = c.select("row", "doc_id", "chunk", at.cast("bigint").alias("at"), F.substring("text", at + 1, F.lit(SPREAD_CHUNK + OVERLAP) + F.col("chunk") * SPREAD_CHUNK - at).alias("text"))
    c = c.repartition("row", "chunk").mapInArrow(_boundaries, "row bigint, doc_id bigint, chunk int, at bigint, text string, left array<bigint>, right array<bigint>")
    in_order = W.partitionBy("row").orderBy("chunk")
    # the first place where both neighbours have a boundary; none: the chunk goes on the piece before
    cut = F.when(F.col("chunk") == 0, 0).otherwise(F.array_min(F.array_intersect("left", F.lag("right").over(in_order))))
    c = c.withColumn("cut", cut).withColumn("begin", F.coalesce("cut", F.col("chunk") * SPREAD_CHUNK))
    c = c.withColumn("until", F.lead("begin").over(in_order)).withColumn("piece", F.count("cut").over(in_order))
    size = F.coalesce(F.col("until") - F.col("begin"), F.length("text").cast("bigint"))
    c = c.select("row", "doc_id", "piece", "chunk", F.substring("text", (F.col("begin") - F.col("at") + 1).cast("int"), size.cast("int")).alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]), "")
    return c.groupBy("row", "doc_id", "piece").agg(joined.alias("text"))


def encode_corpus(documents: DataFrame, name: str = TOKENIZER, folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id``, ``ids``: one row for each row of ``documents``.

    No special tokens: text that looks like one is plain text. Empty and null
    texts give an empty list. Rows of one ``doc_id`` each give their row.
    """
    d = documents.select("doc_id", "text")
    is_long = F.coalesce(F.length("text") > SPREAD, F.lit(False))
    short = d.filter(~is_long).mapInArrow(_encoder("ids", name, folder), "doc_id bigint, ids array<int>")
    pieces = pieces_of_long_texts(d.filter(is_long).withColumn("row", F.monotonically_increasing_id()))
    encoded = pieces.mapInArrow(_encoder("ids", name, folder), "row bigint, doc_id bigint, piece bigint, ids array<int>")
    whole = encoded.groupBy("row", "doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias("ids"))
    return short.unionByName(whole.select("doc_id", "ids"))


def token_counts(documents: DataFrame, name: str = TOKENIZER, folder: str = TOKENIZERS) -> DataFrame:
    """All columns but ``text``, and ``n_tokens``: how many ids each text has; 0 for null."""
    kept = [c for c in documents.columns if c != "text"]
    d = documents.select(*kept, "text")
    schema = ", ".join(f"`{c}` {t}" for c, t in d.select(*kept).dtypes) + ", n_tokens bigint"
    return d.mapInArrow(_encoder("n_tokens", name, folder, counts_only=True), schema)


def decode(ids: Column, name: str = TOKENIZER, folder: str = TOKENIZERS) -> Column:
    """The text of a list of ids: their bytes in one row, read as UTF-8; null for null."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        decoded = encoding(name, folder).decode_bytes
        return s.map(lambda x: None if x is None else decoded([int(i) for i in x]).decode("utf-8", "replace"))

    return run(ids)
