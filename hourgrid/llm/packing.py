"""Packing token sequences by best-two-fit.

A sequence is filled greedily: the longest piece left, then again and again the longest that fits.  Then its
shortest piece is put back and replaced by the two pieces left that fill the widened gap best, if together they
are longer than the piece was.  Only lengths matter to this, so it runs on the histogram of lengths, which has
no more entries than a sequence has tokens: a filling is repeated as often as its lengths last, which is what one
sequence after the other would come to.  The pieces themselves are numbered within their length by a
distributed sort and look their place up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hourgrid.llm import chunkcodes as C, textscan as S
from hourgrid.llm.numbering import number_rows
from hourgrid.llm.scratch import Scratch

CAPACITY = 2048
END_ID = 0
#: Text bytes encoded at once.
TEXT_BYTES = 1 << 20
#: Stretches of text that a worker keeps in a generation while a task runs.
KEPT = 120_000


def default_coder() -> C.ChunkCoder:
    """The public 50k byte-level vocabulary; workers that do other work afterwards keep nothing of the texts."""
    import public_tokenizers

    return C.byte_level_coder(public_tokenizers.path("byte_bpe_50k.json"), kept=KEPT)


def pieces(docs: DataFrame, capacity: int = CAPACITY, make=default_coder) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece; a document longer than ``capacity`` is cut so
    that all pieces but the first are full."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = C.coder_of_worker(make)
        for part in parts:
            for row, scan in S.slices(part.column("text"), TEXT_BYTES):
                ids, at = C.encode_rows(coder, scan.data, scan.row_start)
                ids = np.insert(ids, at[1:], END_ID)
                length = np.diff(at) + 1
                count = -(-length // capacity)
                owner = np.repeat(np.arange(scan.rows), count)
                piece = C.spread(np.zeros(scan.rows, np.int64), count)
                head = (length - (count - 1) * capacity)[owner]
                start = np.where(piece > 0, head + (piece - 1) * capacity, 0)
                size = np.where(piece > 0, capacity, head)
                begin = (np.cumsum(length) - length)[owner] + start
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begin.tolist(), (begin + size).tolist())]
                arrays = [part.column("doc_id").take(pa.array(row + owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])
        coder.forget()

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {doc_type}, piece int, start long, length long, ids_crc32 long")


def fillings(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of one sequence, how many such sequences) until ``counts`` (by length, from 0) is used up."""
    left = counts.astype(np.int64).copy()
    lengths = np.arange(capacity + 1)
    out = []
    while left.any():
        fit = np.maximum.accumulate(np.where(left > 0, lengths, 0))  # the longest piece left of at most this length
        gap, bin_, now = capacity, [], left.copy()
        while gap > 0 and (x := int(fit[gap])):
            bin_.append(x)
            gap -= x
            now[x] -= 1
            if not now[x]:
                fit = np.maximum.accumulate(np.where(now > 0, lengths, 0))
        smallest = bin_[-1]
        room = gap + smallest
        if gap and room > 1:
            first = np.flatnonzero(now[: room] > 0)
            first = first[first > 0]
            rest = np.minimum(fit[room - first], lengths[room - first]) if len(first) else first
            alone = (rest == first) & (now[first] < 2)
            if alone.any():  # the one piece of that length cannot be taken twice
                rest = np.where(alone, fit[np.minimum(room - first, first - 1)], rest)
            total = np.where(rest > 0, first + rest, 0)
            if len(total) and total.max() > smallest:
                k = int(total.argmax())
                bin_ = sorted([*bin_[:-1], int(first[k]), int(rest[k])], reverse=True)
        size, times = np.unique(bin_, return_counts=True)
        repeat = int((left[size] // times).min())
        left[size] -= repeat * times
        out.append((bin_, repeat))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, make=default_coder) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row.

    A null text is empty: its document is the end id alone.  Repeated rows are packed one by one; a null doc_id
    is carried through; other columns are not read; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.save(pieces(docs, capacity, make), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    numbered = number_rows(scratch, cut, ["length", "doc_id", "piece", "start", "ids_crc32"])

    base = np.concatenate([[0], np.cumsum(counts)])
    size, low, per, sequence, offset = [], [], [], [], []  # one entry a filling and length: the row numbers from ``low`` on
    used, sequences = base[:-1].copy(), 0
    for bin_, repeat in fillings(counts, capacity):
        at = np.concatenate([[0], np.cumsum(bin_)])
        for x in dict.fromkeys(bin_):
            places = [int(at[i]) for i, y in enumerate(bin_) if y == x]
            size.append(x)
            low.append(int(used[x]))
            per.append(len(places))
            sequence.append(sequences)
            offset.append(places)
            used[x] += repeat * len(places)
        sequences += repeat
    order = np.argsort(low, kind="stable")
    low, per, sequence = (np.array(v, np.int64)[order] for v in (low, per, sequence))
    spot = np.concatenate([[0], np.cumsum(per)])
    offset = np.array([p for i in order for p in offset[i]], np.int64)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            number = part.column("row_number").to_numpy()
            entry = np.searchsorted(low, number, side="right") - 1
            rank = number - low[entry]
            place = offset[spot[entry] + rank % per[entry]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(sequence[entry] + rank // per[entry]), pa.array(place)],
                                             [*names, "sequence_id", "offset"])

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return numbered.mapInArrow(batches, f"doc_id {doc_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
