"""A Bloom filter of fixed greatest size, to screen rows beside the scan before an exact join."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits: 16 MB at most, whatever the size of the corpus. Beyond about 10 million keys more rows pass; the exact join after it keeps results right.
MOST_WORDS = 1 << 21


def _place(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    u = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    u ^= u >> np.uint64(32)
    one = np.uint64(1)
    bits = (one << (u >> np.uint64(58))) | (one << ((u >> np.uint64(52)) & np.uint64(63))) | (one << ((u >> np.uint64(46)) & np.uint64(63)))
    return (u & np.uint64(words - 1)).astype(np.int64), bits


class Screen:
    """Which bigint keys may be in a column; what it denies is surely not."""

    def __init__(self, keys: DataFrame, most_words: int = MOST_WORDS, bits: int = 24):
        n = keys.count()  # ``bits`` a key as long as there is room
        self.words = words = min(most_words, 1 << max(10, (n * bits // 64).bit_length()))

        def place(batches):
            for b in batches:
                where, bits = _place(np.asarray(b.column(0)).astype(np.int64), words)
                yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(bits.view(np.int64))], ["word", "bits"])

        rows = keys.mapInArrow(place, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        table = np.zeros(words, np.uint64)
        table[np.asarray(rows["word"])] = np.asarray(rows["bits"]).view(np.uint64)
        self.shared = keys.sparkSession.sparkContext.broadcast(table.tobytes())

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        table = np.frombuffer(self.shared.value, np.uint64)
        where, bits = _place(np.ascontiguousarray(keys, np.int64), self.words)
        return (table[where] & bits) == bits

    def __getstate__(self):
        return {"words": self.words, "shared": self.shared}


def only(screen: Screen) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: the rows whose ``doc_id`` the screen lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(screen(np.asarray(batch.column("doc_id")))))

    return run
