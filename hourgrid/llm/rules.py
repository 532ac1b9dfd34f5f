r"""Quality rules: exact document statistics, fixed limits, and boosted trees over the statistics.

Words are runs of characters other than space and \t \n \v \f \r.  Statistics are taken over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hourgrid.llm import boost, textscan as S

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Labelled rows the trees are fitted on at most, taken in the order of a hash of their id.
FIT_ROWS = 6000
#: A document is rejected when the trees give label 1 less than this probability.
KEEP_AT = 0.3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Inputs of the trees; the sign is the direction in which the verdict may move with the value.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1,
    "digit_share": -1, "stop_share": 0, "distinct_share": 0, "line_words": 0, "same_next_share": -1, "symbol_word_share": -1,
}
MONOTONE = np.array(list(FEATURES.values()))
STATS = ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>"


def _in(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOL, _UPPER, _DIGIT, _STOP = _in(SYMBOLS), _in(bytes(range(65, 91))), _in(b"0123456789"), _in(b".!?")
_LETTER = _in(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))


def _marked(table: np.ndarray, scan: S.Scan) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(table[scan.data])])
    return np.diff(total[scan.row_start])


def _repeats(row: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every item: is its digest found twice or more in its row, and is it a later one of them?"""
    order = np.lexsort((digest, row))
    same = (row[order][1:] == row[order][:-1]) & (digest[order][1:] == digest[order][:-1])
    later, twice = np.zeros(len(row), bool), np.zeros(len(row), bool)
    later[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice, later


def statistics(scan: S.Scan) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The five counts and the features of every row of a slice."""
    n = scan.rows
    start, end, row = scan.words()
    words = S.per_row(row, n)
    point = np.concatenate([[0], np.cumsum(S.code_points(scan.data))])
    chars = np.bincount(row, point[end] - point[start], minlength=n).astype(np.int64)
    symbols = _marked(_SYMBOL, scan)

    left, right, line_row = scan.lines()
    with_word = np.searchsorted(start, left, side="left") < np.searchsorted(start, right, side="left")
    left, right, line_row = left[with_word], right[with_word], line_row[with_word]
    dup_lines = S.per_row(line_row[_repeats(line_row, scan.hash_of(left, right))[1]], n)

    word_hash = scan.hash_of(start, end)
    window, first = S.windows(word_hash, row, REPEAT_WINDOW)
    hit = first[_repeats(row[first], window)[0]]
    cover = np.zeros(len(start) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, np.minimum(hit + REPEAT_WINDOW, len(start)), -1)
    covered = np.cumsum(cover)[:-1] > 0
    repeat_words = S.per_row(row[covered], n)

    counts = {"n_words": words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat_words}
    per_word, per_char, lines = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(S.per_row(line_row, n), 1)
    distinct = words - S.per_row(row[_repeats(row, word_hash)[1]], n)
    same_next = S.per_row(row[1:][(row[1:] == row[:-1]) & (word_hash[1:] == word_hash[:-1])], n)
    total = np.concatenate([[0], np.cumsum(_SYMBOL[scan.data])])
    features = np.stack([
        np.log1p(words), chars / per_word, symbols / per_char, dup_lines / lines, repeat_words / per_word,
        _marked(_UPPER, scan) / np.maximum(_marked(_LETTER, scan), 1), _marked(_DIGIT, scan) / per_char, _marked(_STOP, scan) / per_word,
        distinct / per_word, words / lines, same_next / per_word, S.per_row(row[total[end] > total[start]], n) / per_word,
    ], 1)
    return counts, features


def with_statistics(docs: DataFrame, keep: list[str], text: str = "text", trees: boost.Trees | None = None) -> DataFrame:
    """The columns ``keep``, the counts, and either the features or, with trees, the score of every row."""
    picked = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    schema = picked.drop("__text").schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    out = (f"{fields}, " if fields else "") + (STATS if trees is None else STATS.replace("features array<double>", "score double"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            held = part.select(keep)
            for first, scan in S.slices(part.column("__text")):
                counts, x = statistics(scan)
                last = pa.array(list(x), pa.list_(pa.float64())) if trees is None else pa.array(trees.probability(x))
                arrays = [*held.slice(first, scan.rows).columns, *(pa.array(counts[c]) for c in COUNTS), last]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, *COUNTS, "features" if trees is None else "score"])

    return picked.mapInArrow(batches, out)


def fit_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> boost.Trees:
    """Trees fitted on at most ``fit_rows`` labelled documents (fewer where fewer are labelled)."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("double").alias("__y"))
    known = known.groupBy("doc_id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    found = with_statistics(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), ["__y"]).select("__y", "features").toPandas()
    x = np.array(found["features"].tolist(), float).reshape(-1, len(FEATURES))
    return boost.fit(x, found["__y"].to_numpy(float), MONOTONE)


def judge(docs: DataFrame, trees: boost.Trees, keep_at: float = KEEP_AT) -> DataFrame:
    """Every row's counts, score and verdict.

    A null or empty text has no words, so it fails the base rules.  Repeated rows are judged one by
    one; a null doc_id is carried through; columns besides doc_id and text are not read, so their
    names cannot clash.  An empty table gives an empty result.
    """
    scored = with_statistics(docs, ["doc_id"], trees=trees)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (scored.withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= keep_at)))
