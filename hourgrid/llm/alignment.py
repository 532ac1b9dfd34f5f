"""Alignment of two tokenizers over the bytes of every text, with corpus-wide counts of linked ids.

A text's A tokens and B tokens cover the same bytes (a space and the text).  Byte offsets at which both have an end cut
the tokens into groups; a link is an occurrence of an A token and one of a B token whose bytes overlap.  Where two
neighbouring ends lie, there is one link, so the links of a text are the pieces between all its ends.

1. Every batch of texts is aligned in numpy, each distinct stretch of text once (``chunkcodes``).  A row per text holds
   its own figures.  Its records (pair of ids, text, occurrences) are sorted by pair, B id first, and written as
   a run for each of RADIX classes of B ids: zstd frames of FRAME records.
2. Runs of a class are dealt to parts of about PART_BYTES by their batch, so a frequent id spreads over many parts.
   A part's runs go through a k-way heap merge that opens one frame a run at a time and counts every pair.
3. Sums over the parts give the count of every pair, and the largest of each B id.  Ids bound their number, not texts.
4. The runs of a part meet the counts of their class once more and stream back what every pair adds to every
   text; the sums by text join the rows of step 1.

Each step's table is written to the shared folder; a lost executor costs a reread.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window as W, functions as F

from hourgrid.llm import chunkcodes as C, textscan as S
from hourgrid.llm.scratch import Scratch, bound_batches

RADIX = 16
FRAME = 65_536
PART_BYTES = 24 << 20
BATCH_BYTES = 3 << 20

_HEAD = struct.Struct("<IIIBB")


@dataclass(frozen=True)
class Side:
    """A tokenizer: the coder of stretches that begin with a space, and the bytes of every id (None: an id that stands for none)."""

    coder: C.ChunkCoder
    tokens: list[bytes | None]

    def __post_init__(self):
        held = [t or b"" for t in self.tokens]
        length = np.array([len(t) for t in held], np.int64)
        object.__setattr__(self, "length", length)
        object.__setattr__(self, "first", np.cumsum(length) - length)
        object.__setattr__(self, "bytes", np.frombuffer(b"".join(held), np.uint8))

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[C.spread(self.first[ids], self.length[ids])]


def byte_level_side(path: str) -> Side:
    """A byte-level vocabulary of the tokenizers library; strings of special tokens are plain text."""
    from tokenizers import Tokenizer

    coder = C.byte_level_coder(path, plain_specials=True)
    return Side(coder, C.byte_level_tokens(Tokenizer.from_file(path)))


def piece_side(path: str) -> Side:
    """A sentencepiece model that puts a space before a text and leaves its characters alone."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens: list[bytes | None] = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            tokens.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            tokens.append(None)
        else:
            tokens.append(piece.replace("▁", " ").encode())
    inner = any(t and b" " in t.lstrip(b" ") for t in tokens)  # such a piece could reach over a cut
    length = np.array([-1 if t is None else len(t) for t in tokens], np.int64)
    space = model.piece_to_id("▁")  # the model gives an empty text no space of its own

    def encode(texts: list[str]) -> list[list[int]]:
        return [ids or [space] for ids in model.encode([t[1:] for t in texts], num_threads=1)]

    coder = C.ChunkCoder(encode, length, cuts=(lambda data: []) if inner else C.space_cuts)
    return Side(coder, tokens)


def default_sides() -> tuple[Side, Side]:
    import public_tokenizers

    return byte_level_side(public_tokenizers.path("byte_bpe_50k.json")), piece_side(public_tokenizers.path("piece_bpe_32k.model"))


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _digits(top: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 .. top with a free place behind, and their number."""
    width = len(str(top))
    if width not in _tables:
        numbers = np.arange(10 ** width)
        text = np.char.ljust(numbers.astype(f"S{width}"), width + 1)
        _tables[width] = text.astype(f"S{width + 1}").view(np.uint8).reshape(-1, width + 1).copy(), np.char.str_len(numbers.astype(f"S{width}"))
    return _tables[width]


class Aligned(NamedTuple):
    """Stretches: whether both sides spell it, tokens, groups, links (with the first in ``pair``) and groups as text."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    pair: np.ndarray
    first: np.ndarray
    text: list[bytes]


def _spelled(side: Side, ids: np.ndarray, owner: np.ndarray, size: np.ndarray, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Which stretches the ids spell byte by byte."""
    good = np.bincount(owner, side.length[ids], len(size)).astype(np.int64) == size
    kept = ids[good[owner]]
    want = data[C.spread(begin[good], size[good])]
    wrong = np.flatnonzero(side.spelled(kept) != want)
    if len(wrong):
        ends = np.cumsum(size[good])
        good[np.flatnonzero(good)[np.searchsorted(ends, wrong, side="right")]] = False
    return good


def align_stretches(words: list[bytes], a: Side, b: Side) -> Aligned:
    n = len(words)
    size = np.array([len(w) for w in words], np.int64)
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(words), np.uint8)
    ids_a, at = C.encode_rows(a.coder, data, np.append(begin, size.sum()))
    owner_a = np.repeat(np.arange(n), np.diff(at))
    coded = b.coder.of(words)
    ids_b = np.frombuffer(b"".join(coded), "<u4")
    owner_b = np.repeat(np.arange(n), [len(c) // 4 for c in coded])
    good = _spelled(a, ids_a, owner_a, size, data, begin) & _spelled(b, ids_b, owner_b, size, data, begin)
    (ids_a, owner_a), (ids_b, owner_b) = ((i[good[o]], o[good[o]]) for i, o in ((ids_a, owner_a), (ids_b, owner_b)))

    end_a, end_b = np.cumsum(a.length[ids_a]), np.cumsum(b.length[ids_b])
    ends = np.union1d(end_a, end_b)
    of_a, of_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    pair = ids_b[of_b].astype(np.uint64) << np.uint64(32) | ids_a[of_a].astype(np.uint64)
    links = np.bincount(owner_a[of_a], minlength=n)
    both = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
    n_groups = np.bincount(owner_a[np.searchsorted(end_a, both)], minlength=n)

    place_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)
    place_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, side="right")
    total = len(ids_a) + len(ids_b)
    ids, side, group, owner = (np.empty(total, np.int64) for _ in range(4))
    ids[place_a], ids[place_b] = ids_a, ids_b
    side[place_a], side[place_b] = 0, 1
    group[place_a], group[place_b] = group_a, group_b
    owner[place_a], owner[place_b] = owner_a, owner_b
    digits, width = _digits(int(max(len(a.tokens), len(b.tokens))))
    shape = digits[ids]
    sign = np.full(total, ord(";"), np.uint8)
    if total:
        sign[:-1][group[1:] == group[:-1]] = ord(",")
        sign[:-1][side[1:] > side[:-1]] = ord("|")
    shape[np.arange(total), width[ids]] = sign
    flat = shape[np.arange(shape.shape[1]) <= width[ids][:, None]].tobytes()
    stop = np.cumsum(np.bincount(owner, width[ids] + 1, n).astype(np.int64)) if total else np.zeros(n, np.int64)
    text = [flat[x: max(x, y - 1)] for x, y in zip([0, *stop[:-1].tolist()], stop.tolist())]
    return Aligned(good, np.bincount(owner_a, minlength=n), np.bincount(owner_b, minlength=n), n_groups, links, pair, np.cumsum(links) - links, text)


def with_space(data: np.ndarray, row_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every text that is not empty with a space before it."""
    filled = row_start[:-1] < row_start[1:]
    return np.insert(data, row_start[:-1][filled], 32), row_start + np.concatenate([[0], np.cumsum(filled)])


def _frames(pair: np.ndarray, row: np.ndarray, times: np.ndarray) -> bytes:
    """A run: records sorted by pair and row, in zstd frames behind their lengths."""
    pack = zstandard.ZstdCompressor(level=3).compress
    out = []
    for i in range(0, len(pair), FRAME):
        p, r, t = pair[i: i + FRAME], row[i: i + FRAME], times[i: i + FRAME]
        new = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        distinct = p[new]
        step = np.diff(distinct, prepend=np.uint64(0))
        gap = np.diff(r, prepend=0)
        gap[new] = r[new]
        wide, long = int(gap.max()) >> 16 > 0, int(t.max()) >> 8 > 0
        gap = gap.astype("<u4" if wide else "<u2")
        planes = gap.view(np.uint8).reshape(len(gap), -1).T.tobytes()  # low bytes, then high ones
        held = step.astype("<u8").tobytes() + np.diff(np.append(new, len(p))).astype("<u4").tobytes() + planes + t.astype("<u4" if long else "u1").tobytes()
        frame = pack(held)
        out += [_HEAD.pack(len(frame), len(new), len(p), wide, long), frame]
    return b"".join(out)


class Run:
    """Frames of a run, one after the other: ``pair``, ``count`` (records of each), ``row`` and ``times``."""

    def __init__(self, run: bytes):
        self.run, self.at = run, 0

    def next(self) -> bool:
        if self.at >= len(self.run):
            return False
        size, pairs, records, wide, long = _HEAD.unpack_from(self.run, self.at)
        begin = self.at + _HEAD.size
        held = zstandard.ZstdDecompressor().decompress(memoryview(self.run)[begin: begin + size])
        self.at = begin + size
        self.pair = np.cumsum(np.frombuffer(held, "<u8", pairs))
        self.count = np.frombuffer(held, "<u4", pairs, 8 * pairs).astype(np.int64)
        width = 4 if wide else 2
        planes = np.frombuffer(held, np.uint8, width * records, 12 * pairs).reshape(width, records)
        self._gap = np.ascontiguousarray(planes.T).view("<u4" if wide else "<u2")[:, 0].astype(np.int64)
        self.times = np.frombuffer(held, "<u4" if long else "u1", records, 12 * pairs + width * records).astype(np.int64)
        return True

    def rows(self) -> np.ndarray:
        total = np.cumsum(self._gap)
        first = np.cumsum(self.count) - self.count
        return total - np.repeat(total[first] - self._gap[first], self.count)

    def weights(self) -> np.ndarray:
        return np.add.reduceat(self.times, np.cumsum(self.count) - self.count)


def merge_counts(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of every pair's occurrences, in the order of the pairs.

    The heap holds the last pair of each run's open frame.  Up to the smallest of these all runs are at hand; that run
    then opens its next frame.  The last pair itself may go on there, so its sum waits for the next step.
    """
    open_runs = [Run(r) for r in runs]
    heap, weight, done = [], {}, {}
    for i, run in enumerate(open_runs):
        if run.next():
            weight[i], done[i] = run.weights(), 0
            heap.append((int(run.pair[-1]), i))
    heapq.heapify(heap)
    out_pair, out_sum = [], []
    held_pair, held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    while heap:
        bound, i = heapq.heappop(heap)
        pairs, sums = [held_pair], [held]
        for _, j in [(bound, i), *heap]:
            stop = int(np.searchsorted(open_runs[j].pair, np.uint64(bound), side="right"))
            if stop > done[j]:
                pairs.append(open_runs[j].pair[done[j]: stop])
                sums.append(weight[j][done[j]: stop])
                done[j] = stop
        if open_runs[i].next():
            weight[i], done[i] = open_runs[i].weights(), 0
            heapq.heappush(heap, (int(open_runs[i].pair[-1]), i))
        key = np.concatenate(pairs)
        order = np.argsort(key, kind="stable")
        key, total = key[order], np.concatenate(sums)[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        key, total = key[new], np.add.reduceat(total, new) if len(new) else total
        keep = int(np.searchsorted(key, np.uint64(bound)))
        out_pair.append(key[:keep])
        out_sum.append(total[:keep])
        held_pair, held = key[keep:], total[keep:]
    return np.concatenate([*out_pair, held_pair]), np.concatenate([*out_sum, held])


def _count(group: pa.Table) -> pa.Table:
    pair, total = merge_counts(group.column("run").to_pylist())
    b = (pair >> np.uint64(32)).astype(np.int64)
    radix = np.full(len(pair), group.column("radix")[0].as_py(), np.int32)
    return pa.table({"radix": radix, "a_id": (pair & np.uint64(0xFFFFFFFF)).astype(np.int64), "b_id": b, "n": total})


def _pack_counts(group: pa.Table) -> pa.Table:
    """The counts of a class as one value: pairs, counts and marks of the largest of their B id."""
    pair = group.column("b_id").to_numpy().astype(np.uint64) << np.uint64(32) | group.column("a_id").to_numpy().astype(np.uint64)
    order = np.argsort(pair)
    parts = [pair[order].astype("<u8").tobytes(), group.column("n").to_numpy()[order].astype("<i8").tobytes(), np.asarray(group.column("best"))[order].astype(np.uint8).tobytes()]
    held = struct.pack("<Q", len(pair)) + zstandard.ZstdCompressor(level=3).compress(b"".join(parts))
    return pa.table({"radix": pa.array([group.column("radix")[0].as_py()], pa.int32()), "counts": pa.array([held], pa.binary())})


def _add_up(runs: pa.Table, counts: pa.Table) -> pa.Table:
    """What the pairs of a part's runs add to every text of its batches."""
    names = ["batch", "row", "n_best", "count_sum"]
    out = []
    if len(runs):
        held = counts.column("counts")[0].as_py()
        n = struct.unpack_from("<Q", held)[0]
        held = zstandard.ZstdDecompressor().decompress(memoryview(held)[8:])
        pairs, total, best = np.frombuffer(held, "<u8", n), np.frombuffer(held, "<i8", n, 8 * n), np.frombuffer(held, "u1", n, 16 * n)
        for batch, blob, rows in zip(runs.column("batch").to_pylist(), runs.column("run").to_pylist(), runs.column("rows").to_pylist()):
            sums, bests = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            run = Run(blob)
            while run.next():
                at = np.repeat(np.searchsorted(pairs, run.pair), run.count)
                row = run.rows()
                np.add.at(sums, row, run.times * total[at])
                np.add.at(bests, row, run.times * best[at])
            some = np.flatnonzero(sums)
            out.append(pa.table([np.full(len(some), batch, np.int64), some.astype(np.int32), bests[some], sums[some]], names))
    empty = pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())], names)
    return pa.concat_tables(out) if out else empty


_sides: dict = {}


def _align(parts: Iterator[pa.RecordBatch], make: Callable, names: list[str]) -> Iterator[pa.RecordBatch]:
    if make not in _sides:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _sides[make] = make()
    a, b = _sides[make]
    for part in parts:
        for at, scan in S.slices(part.column("__text"), BATCH_BYTES):
            data, row_start = with_space(scan.data, scan.row_start)
            starts, first = C.stretches(data, row_start, b.coder.cuts)
            words, which = C.distinct(data, starts)
            found = align_stretches(words, a, b)
            row = np.repeat(np.arange(scan.rows), np.diff(first))
            lost = np.bincount(row, ~found.good[which], scan.rows) > 0
            sums = [np.where(lost, 0, np.bincount(row, n[which], scan.rows)).astype(np.int64) for n in (found.n_a, found.n_b, found.n_groups, found.n_links)]
            marks = []
            numbers = which.tolist()
            for r, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                marks.append("" if x == y or lost[r] else hashlib.sha256(b";".join(map(found.text.__getitem__, numbers[x:y]))).hexdigest())
            batch = part.column("__batch")[at].as_py()
            keys = part.column("doc_id").slice(at, scan.rows)
            same = pa.array(np.full(scan.rows, batch, np.int64))
            rows = [same, pa.array(np.arange(scan.rows, dtype=np.int32)), keys, *map(pa.array, sums), pa.array(marks),
                    pa.nulls(scan.rows, pa.int32()), pa.nulls(scan.rows, pa.int32()), pa.nulls(scan.rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(rows, names)

            live = np.flatnonzero(~lost[row])
            which, row = which[live], row[live]
            pairs, code = np.unique(found.pair, return_inverse=True)
            link = code[C.spread(found.first[which], found.n_links[which])]
            record, times = np.unique(link * scan.rows + np.repeat(row, found.n_links[which]), return_counts=True)
            code, row = record // scan.rows, record % scan.rows
            radix = (S.mix(pairs >> np.uint64(32)) % np.uint64(RADIX)).astype(np.int32)[code]
            order = np.argsort(radix, kind="stable")
            edge = np.searchsorted(radix[order], np.arange(RADIX + 1))
            blobs = [(r, _frames(pairs[code[i]], row[i], times[i])) for r in range(RADIX) if len(i := order[edge[r]: edge[r + 1]])]
            for r, blob in blobs:
                one = [pa.array([batch], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, keys.type), *(pa.nulls(1, pa.int64()) for _ in range(4)), pa.nulls(1, pa.string()),
                       pa.array([r], pa.int32()), pa.array([scan.rows], pa.int32()), pa.array([blob], pa.binary())]
                yield pa.RecordBatch.from_arrays(one, names)


class Alignment(NamedTuple):
    """``documents``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.  ``pairs``: a_id, b_id, n, best."""

    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, make: Callable[[], tuple[Side, Side]] = default_sides) -> Alignment:
    """Aligns the two tokenizers that ``make`` gives over every text of ``docs`` (doc_id, text).

    n_best counts the links of a text whose pair is the most frequent of its B id in the corpus, ties included;
    count_sum adds up the counts of its links' pairs (as a long).  A null or empty text, and one whose tokens of either
    side do not spell it, has no tokens: zeros and an empty groups_sha256, and nothing of it is counted.  Every row is
    a text of its own, also under a repeated or null doc_id; other columns are not read; an empty table gives
    empty results.
    """
    spark = bound_batches(docs.sparkSession)
    scratch = Scratch(spark, "alignment")
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["batch", "row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "radix", "rows", "run"]
    kinds = ["long", "int", doc_type, "long", "long", "long", "long", "string", "int", "int", "binary"]
    texts = docs.select("doc_id", F.col("text").alias("__text"), F.monotonically_increasing_id().alias("__batch"))
    first = scratch.save(texts.mapInArrow(lambda parts: _align(parts, make, names), ", ".join(f"{n} {k}" for n, k in zip(names, kinds))), "aligned")

    runs = first.where("radix IS NOT NULL").select("batch", "radix", "rows", "run")
    size = {r["radix"]: r["n"] for r in runs.groupBy("radix").agg(F.sum(F.octet_length("run").cast("long")).alias("n")).collect()}  # RADIX rows
    parts = F.array(*(F.lit(max(1, -(-size.get(r, 0) // PART_BYTES))) for r in range(RADIX)))
    runs = runs.withColumn("part", F.pmod(F.xxhash64("batch"), F.get(parts, F.col("radix"))).cast("int"))
    counted = scratch.save(runs.groupBy("radix", "part").applyInArrow(lambda g: _count(g), "radix int, a_id long, b_id long, n long"), "counted")
    sums = counted.groupBy("radix", "b_id", "a_id").agg(F.sum("n").alias("n"))
    pairs = scratch.save(sums.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy("b_id"))), "pairs")
    scratch.drop("counted")

    packed = pairs.groupBy("radix").applyInArrow(lambda g: _pack_counts(g), "radix int, counts binary")
    packed = packed.withColumn("part", F.explode(F.sequence(F.lit(0), (F.get(parts, F.col("radix")) - 1).cast("int"))))
    added = runs.groupBy("radix", "part").cogroup(packed.groupBy("radix", "part")).applyInArrow(
        lambda some, counts: _add_up(some, counts), "batch long, row int, n_best long, count_sum long")
    total = added.groupBy("batch", "row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = first.where("radix IS NULL").drop("radix", "rows", "run").join(total, ["batch", "row"], "left")
    zero = F.lit(0).cast("long")
    documents = rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
    return Alignment(documents, pairs.select("a_id", "b_id", "n", "best"))
