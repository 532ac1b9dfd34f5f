"""Sharding by a keyed permutation of the global row numbers.

A balanced Feistel network permutes the smallest even power-of-two range that holds all row numbers; a number
that leaves the table is sent through again until it is back inside (cycle walking), which makes a
permutation of exactly the rows.  The place of a row in the shuffle, its shard and its slot follow from its
number by arithmetic alone, and the place's row by the inverse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hourgrid.llm.numbering import number_rows
from hourgrid.llm.scratch import Scratch
from hourgrid.llm.textscan import mix

ROUNDS = 6
SHARDS = 24


class Permutation:
    """A seeded permutation of 0 .. size - 1."""

    def __init__(self, size: int, seed: int = 0):
        self.size = size
        self.half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) & ((1 << 64) - 1)))

    def _once(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in keys:
            if back:
                left, right = right ^ (mix(left + key) & self.mask), left
            else:
                left, right = right, left ^ (mix(right + key) & self.mask)
        return (left << self.half) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        keys = self.keys[::-1] if back else self.keys
        out = self._once(np.asarray(x).astype(np.uint64), keys, back)
        outside = np.flatnonzero(out >= np.uint64(self.size))
        while len(outside):
            out[outside] = self._once(out[outside], keys, back)
            outside = outside[out[outside] >= np.uint64(self.size)]
        return out.astype(np.int64)

    def place(self, row: np.ndarray) -> np.ndarray:
        return self._walk(row, False)

    def row(self, place: np.ndarray) -> np.ndarray:
        return self._walk(place, True)


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law (`rows`), shard, slot and grown_shard (null under this law) of every row.

    Place p of the shuffle lies in shard p mod ``shards`` at slot p div ``shards``, so row counts differ by
    one at most and slots have no gaps.  Row numbers follow doc_id, then checksum and size; the same
    table and seed give the same places however the table is partitioned.  A null text has no bytes (size 8,
    checksum 0) as an empty one; null doc_ids come first; repeated rows get a place each; other columns are
    not read; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = docs.select("doc_id", F.crc32(text).alias("text_crc32"), (F.octet_length(text) + 8).cast("long").alias("size"))
    numbered = number_rows(scratch, keys, ["doc_id", "text_crc32", "size"])
    total = docs.count()
    order = Permutation(max(total, 1), seed)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            place = order.place(part.column("row_number").to_numpy())
            shard, slot = (place % shards).astype(np.int32), place // shards
            arrays = [part.column("doc_id"), part.column("size"), part.column("text_crc32"), pa.array(["rows"] * len(place)),
                      pa.array(shard), pa.array(slot), pa.nulls(len(place), pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"])

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return numbered.mapInArrow(batches, f"doc_id {doc_type}, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")
