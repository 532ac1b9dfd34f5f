"""Passages that repeat across documents, by content-defined chunks and their digests.

A gear hash rolls over the bytes of a text; a chunk ends where a few of its middle bits are zero, which depends on
the last GEAR_BYTES bytes alone, and where no other such place lies in the MIN_CHUNK bytes before.  So an insertion moves
no boundary but those next to it, and a shared passage has the same chunks in every document but for its edges.
Chunks are counted by digest; a run of successive chunks that all occur in other documents and together are
MIN_RUN code points long is a repeated passage.  The chunk size is a fraction of a passage, so a passage of fifty
words holds several whole chunks; single chunks that repeat, such as common turns of phrase, make no run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from hourgrid.llm import textscan as S
from hourgrid.llm.scratch import Scratch

#: Bits 15 to 19 of the gear hash see the last 20 bytes; five of them give chunks of 32 bytes and the minimum.
GEAR_BITS, FIRST_BIT = 5, 15
GEAR_BYTES = FIRST_BIT + GEAR_BITS
MIN_CHUNK = 8
#: A longer stretch without boundary repeats itself; it is cut at the low points of the hash, which then repeat too.
LONG_CHUNK, LOW_REACH = 256, 64
MAX_CHUNK = 4096
#: Code points of a run.  A passage of fifty words loses about one chunk and the gear's bytes at its edges.
MIN_RUN = 100

_GEAR = (S.mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear_hash(data: np.ndarray, row_start: np.ndarray) -> np.ndarray:
    """Rolling hash at every byte over the bytes before it in its row, by doubling the window."""
    rows = len(row_start) - 1
    size = np.diff(row_start)
    place = np.arange(len(data)) + 32 * (np.repeat(np.arange(rows), size) + 1)
    total = np.zeros(len(data) + 32 * (rows + 1), np.uint32)
    total[place] = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        total[k:] = total[k:] + (total[:-k] << np.uint32(k))
    return total[place]


def boundaries(scan: S.Scan) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every chunk of a slice; chunks never cross rows."""
    gear = gear_hash(scan.data, scan.row_start)
    hit = np.flatnonzero(((gear >> np.uint32(FIRST_BIT)) & np.uint32((1 << GEAR_BITS) - 1)) == 0) + 1
    apart = np.ones(len(hit), bool)
    apart[1:] = np.diff(hit) >= MIN_CHUNK
    edge = np.unique(np.concatenate([hit[apart], scan.row_start]))
    long = np.flatnonzero(np.diff(edge) > LONG_CHUNK)
    if len(long):
        edge = np.unique(np.concatenate([edge, *(a + _low_points(gear[a:b]) + 1 for a, b in zip(edge[long], edge[long + 1]))]))
        edge = edge[edge <= len(scan.data)]
        gap = np.diff(edge)
        edge = np.unique(np.concatenate([edge, *(np.arange(a, a + g, MAX_CHUNK) for a, g in zip(edge[:-1], gap) if g > MAX_CHUNK)]))
    return edge[:-1], edge[1:]


def _low_points(gear: np.ndarray) -> np.ndarray:
    """Where the hash is the lowest within LOW_REACH bytes to either side, ties included."""
    top = np.iinfo(np.uint32).max
    least = np.concatenate([np.full(LOW_REACH, top, np.uint32), gear, np.full(LOW_REACH, top, np.uint32)])
    span = 1
    while span < 2 * LOW_REACH + 1:
        step = min(span, 2 * LOW_REACH + 1 - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return np.flatnonzero(gear == least)


def _chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        ids = part.column(0)
        for first, scan in S.slices(part.column(1)):
            start, end = boundaries(scan)
            row = scan.row_of(start)
            ordinal = np.arange(len(start)) - np.searchsorted(row, row, side="left")
            point = np.concatenate([[0], np.cumsum(S.code_points(scan.data))])
            base = point[scan.row_start[row]]
            whole = scan.hash_of(scan.row_start[:-1], scan.row_start[1:]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(first + row)), pa.array(whole[row]), pa.array(scan.hash_of(start, end).view(np.int64)), pa.array(ordinal.astype(np.int32)),
                 pa.array((point[start] - base).astype(np.int32)), pa.array((point[end] - base).astype(np.int32))],
                ["doc_id", "version", "digest", "ordinal", "start", "end"])


def chunked(docs: DataFrame) -> DataFrame:
    """Every chunk of every text: doc_id, a hash of the whole text, the chunk's digest, ordinal and code points."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    return rows.mapInArrow(_chunks, f"doc_id {doc_type}, version long, digest long, ordinal int, start int, end int")


def repeated_passages(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """doc_id, version (hash of the text), run, start, end, first_doc_id and kept of every repeated passage.

    ``run`` is where the passage begins.  It is given in spans: a chunk is kept in the smallest doc_id that holds it,
    so a passage may be kept in part, and dropping what is not kept leaves every chunk once; ``first_doc_id`` is
    the smallest such doc_id of a span.  Rows with null doc_id or text, and empty texts, have no chunks.  Repeated
    rows are one document; rows of one doc_id with different texts are looked at apart, but a passage that only they
    share does not count as one across documents.  Other columns are not read; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    found = chunked(docs)
    spread = found.groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last"))
    repeated = scratch.save(spread.where("first_doc_id <> last").drop("last"), "digests")
    hits = chunked(docs).join(repeated, "digest").select("doc_id", "version", "ordinal", "start", "end", "first_doc_id").distinct()
    doc = ["doc_id", "version"]
    hits = hits.withColumn("island", F.col("ordinal") - F.row_number().over(W.partitionBy(*doc).orderBy("ordinal")))
    whole = W.partitionBy(*doc, "island")
    hits = hits.withColumn("run", F.min("start").over(whole)).withColumn("stop", F.max("end").over(whole)).where(F.col("stop") - F.col("run") >= min_run)
    hits = hits.withColumn("kept", F.col("first_doc_id") == F.col("doc_id"))
    part = F.col("ordinal") - F.row_number().over(W.partitionBy(*doc, "run", "kept").orderBy("ordinal"))
    return hits.withColumn("part", part).groupBy(*doc, "run", "kept", "part").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_doc_id").alias("first_doc_id")).drop("part")


def drop_repeats(docs: DataFrame, passages: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the passages that are not kept; texts without any are unchanged."""
    cut = passages.where(~F.col("kept")).groupBy("doc_id", "version").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cut"))
    by_doc = cut.groupBy("doc_id").agg(F.collect_list(F.struct("version", "cut")).alias("__cuts"))
    joined = docs.join(by_doc, "doc_id", "left").select(*docs.columns, "__cuts")
    at, width = docs.columns.index(text), len(docs.columns)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, cuts = part.column(at).to_pylist(), part.column(width).to_pylist()
            version = np.concatenate([np.zeros(0, np.int64), *(s.hash_of(s.row_start[:-1], s.row_start[1:]).view(np.int64) for _, s in S.slices(part.column(at)))])
            for i, some in enumerate(cuts):
                for c in some or ():
                    if c["version"] == version[i]:
                        out, end = [], 0
                        for span in c["cut"]:
                            out.append(texts[i][end: span["start"]])
                            end = span["end"]
                        texts[i] = "".join([*out, texts[i][end:]])
            yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(texts, part.schema.field(at).type), *part.columns[at + 1: -1]], [n for n in part.schema.names[:-1]])

    return joined.mapInArrow(batches, docs.schema)
