"""Quality classifier: n-gram indicators scaled by class log-count ratios, and a linear hinge-loss model.

N-grams are taken over two readings of a text: its lower-cased words (one and two) and the words' forms
(one to three).  A form says how a word looks and whether it or the passage it begins has just been seen:
letter case, symbols, digits, last character, length, equal to the word before, opening five words that the
text has already had.  All are hashed into one table of BUCKETS indicators.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hourgrid.llm import textscan as S

BITS = 18
BUCKETS = 1 << BITS
SEEN_WINDOW = 5
#: Labelled rows the model is fitted on at most, taken in the order of a hash of their id.
FIT_ROWS = 6000
ACCEPT_AT = 0.3

_CLASS = np.zeros(256, np.int64)  # 0 other ASCII
_CLASS[list(range(97, 123)) + list(range(128, 256))] = 1
_CLASS[list(range(65, 91))] = 2
_CLASS[list(range(48, 58))] = 3
_CLASS[list(b".,;:!?")] = 4
_CLASS[list(b"#*$%&|<>~^_=+@/\\{}[]")] = 5


def _bucket(code: np.ndarray, salt: int) -> np.ndarray:
    return (S.mix(code ^ np.uint64(salt * 0xD1B54A32D192ED03 & (1 << 64) - 1)) >> np.uint64(64 - BITS)).astype(np.int64)


def _forms(scan: S.Scan, start: np.ndarray, end: np.ndarray, row: np.ndarray, digest: np.ndarray) -> np.ndarray:
    kind = _CLASS[scan.data]
    counts = []
    for c in (1, 2, 3, 5):
        total = np.concatenate([[0], np.cumsum(kind == c)])
        counts.append(total[end] - total[start])
    lower, upper, digits, symbols = counts
    length = end - start
    case = np.where(upper == 0, np.where(lower > 0, 0, 1), np.where(lower == 0, np.where(upper > 1, 2, 3), np.where(upper == 1, 4, 5)))
    form = case * 6 + (kind[end - 1] if len(end) else 0)
    form = form * 3 + np.minimum(symbols, 2)
    form = form * 3 + np.minimum(digits, 2)
    form = form * 4 + np.searchsorted([2, 12, 40], length)
    same = np.zeros(len(form), bool)
    same[1:] = (digest[1:] == digest[:-1]) & (row[1:] == row[:-1])
    seen = np.zeros(len(form), bool)
    window, first = S.windows(digest, row, SEEN_WINDOW)
    order = np.lexsort((first, window, row[first]))
    again = (window[order][1:] == window[order][:-1]) & (row[first][order][1:] == row[first][order][:-1])
    seen[first[order[1:]][again]] = True
    return ((form * 2 + same) * 2 + seen).astype(np.uint64)


def indicators(scan: S.Scan) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of a slice, ordered by row."""
    lower = S.lowered(scan)
    start, end, row = lower.words()
    digest = lower.hash_of(start, end)
    form = S.mix(_forms(scan, start, end, row, digest) + np.uint64(1))
    rows, buckets = [row], [_bucket(digest, 1)]
    for salt, (stream, n) in enumerate(((digest, 2), (form, 1), (form, 2), (form, 3)), 2):
        gram, first = S.windows(stream, row, n)
        rows.append(row[first])
        buckets.append(_bucket(gram, salt))
    pair = np.unique((np.concatenate(rows) << BITS) | np.concatenate(buckets))
    return pair >> BITS, pair & (BUCKETS - 1)


@dataclass
class Model:
    """``ratio`` scales the indicators, ``weight`` is the hinge-loss model on the scaled unit vectors;
    ``slope`` and ``offset`` turn a margin into a probability."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, row: np.ndarray, bucket: np.ndarray, rows: int) -> np.ndarray:
        norm = np.sqrt(np.bincount(row, np.square(self.ratio[bucket], dtype=np.float64), rows))
        raw = np.bincount(row, (self.ratio * self.weight)[bucket], rows)
        margin = raw / np.where(norm > 0, norm, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))


def log_count_ratio(docs: list[np.ndarray], y: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    counts = [np.full(BUCKETS, smoothing) for _ in range(2)]
    for x, label in zip(docs, y):
        counts[int(label)][x] += 1
    bad, good = (c / c.sum() for c in counts)
    return np.log(good / bad)


def dual_descent(docs: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss; the bias is one more constant feature.
    Each class has the same total cost."""
    weight, bias = np.zeros(BUCKETS), 0.0
    alpha = np.zeros(len(docs))
    sign = np.where(y > 0, 1.0, -1.0)
    upper = cost * len(y) / (2 * np.where(y > 0, max(y.sum(), 1), max((1 - y).sum(), 1)))
    values = []
    for x in docs:
        v = ratio[x]
        norm = np.sqrt(v @ v)
        values.append(v / norm if norm > 0 else v)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(docs)):
            x, v = docs[i], values[i]
            gradient = sign[i] * (weight[x] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / (v @ v + 1), 0.0), upper[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                weight[x] += step * v
                bias += step
                alpha[i] = new
    return weight, bias


def calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins (Newton steps on smoothed targets)."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    x = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target))
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
    return float(max(a, 1e-6)), float(b)


def fit(docs: list[np.ndarray], y: np.ndarray) -> Model:
    """The model of indicator lists with labels 0 and 1.  Every fifth row is kept from the first fit and
    calibrates it.  Without rows, or with one class only, every score is that class's smoothed share."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(y) < 10 or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    tuned = np.arange(len(y)) % 5 == 0
    part = [d for d, t in zip(docs, tuned) if not t]
    slope, offset = 4.0, 0.0
    if len(set(y[~tuned])) == len(set(y[tuned])) == 2:
        ratio = log_count_ratio(part, y[~tuned])
        first = Model(ratio, *dual_descent(part, y[~tuned], ratio), 1.0, 0.0)
        held = [d for d, t in zip(docs, tuned) if t]
        p = first.score(np.repeat(np.arange(len(held)), [len(d) for d in held]), np.concatenate(held).astype(np.int64), len(held))
        slope, offset = calibrate(np.log(p / (1 - p)), y[tuned])
    ratio = log_count_ratio(docs, y)
    weight, bias = dual_descent(docs, y, ratio)
    return Model(ratio.astype(np.float32), weight.astype(np.float32), bias, slope, offset)


def _collected(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        labels = part.column("__y")
        for first, scan in S.slices(part.column("text")):
            row, bucket = indicators(scan)
            at = np.searchsorted(row, np.arange(scan.rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(bucket, pa.int32()))
            yield pa.RecordBatch.from_arrays([labels.slice(first, scan.rows), lists], ["__y", "buckets"])


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """A model fitted on at most ``fit_rows`` labelled documents; rows without label, doc_id or text do not count."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("double").alias("__y"))
    known = known.groupBy("doc_id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    found = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(known), "doc_id").select("__y", "text")
    table = found.mapInArrow(_collected, "__y double, buckets array<int>").toArrow()
    lists = table.column("buckets").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    if not len(table):
        return fit([], np.zeros(0))
    flat, at = np.asarray(lists.values), np.asarray(lists.offsets)
    return fit([flat[a:b] for a, b in zip(at[:-1], at[1:])], table.column("__y").to_numpy())


def classify(docs: DataFrame, model: Model, keep: list[str] | None = None, accept_at: float = ACCEPT_AT) -> DataFrame:
    """The columns ``keep`` (doc_id by default) with score and predicted.

    Only the text is scored.  A null or empty text has no indicators and gets the score of the bias alone;
    repeated rows get equal scores; columns that are not in ``keep`` are not read.  ``keep`` must not name
    score or predicted.  An empty table gives an empty result.
    """
    keep = ["doc_id"] if keep is None else keep
    picked = docs.select(*[F.col(c) for c in keep], F.col("text").alias("__scored"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.drop("__scored").schema)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            held = part.select(keep)
            for first, scan in S.slices(part.column("__scored")):
                score = model.score(*indicators(scan), scan.rows)
                yield pa.RecordBatch.from_arrays([*held.slice(first, scan.rows).columns, pa.array(score)], [*keep, "score"])

    scored = picked.mapInArrow(batches, f"{fields}, score double")
    return scored.withColumn("predicted", (F.col("score") >= accept_at).cast("int"))


def accepted(docs: DataFrame, model: Model, text: str = "text", accept_at: float = ACCEPT_AT) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with all their columns, whatever their names."""
    at = docs.columns.index(text)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            score = [model.score(*indicators(scan), scan.rows) for _, scan in S.slices(part.column(at))]
            if score:
                yield part.filter(pa.array(np.concatenate(score) >= accept_at))

    return docs.mapInArrow(batches, docs.schema)
