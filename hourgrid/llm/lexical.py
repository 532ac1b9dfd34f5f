r"""Exact ranked lexical search by norm buckets of impact vectors.

Terms are the maximal runs of letters and digits of ASCII (A-Z in lower case) and of all other characters.  With N
documents that have a term, L terms in all, n terms in a document, df documents with a term and tf of it in a document,

    w = floor(1000 * ln((2 N + 2) / (2 df + 1)))    m = 100 - 25 + ((25 n N) div L)    score = sum of w * ((10^9 tf) div (1000 tf + 12 m))

over the terms of a query, repeats included.  A document is a vector of impacts, a query one of weights; a coordinate of
either is scaled by sqrt(w), which leaves products as they are and keeps frequent terms from making vectors long.

1. One pass over the texts counts the terms of the queries in every document, and its terms in all.
2. Impact vectors are range-partitioned by length, longest first, and cut into buckets of BUCKET documents.
3. A query visits buckets in that order.  Cauchy-Schwarz ends its visits where query length times the bucket's longest
   vector falls below its kth score.  Inside a bucket, the FOCUS heaviest coordinates of the query are multiplied out and
   the rest is bounded by the lengths that remain; only documents whose bound reaches the kth score are scored, in
   integers.  Both bounds have room for rounding.
4. The kth score rises from bucket to bucket in a task, and from round to round for all tasks: first the partition of the
   longest vectors, then as many as the square root of their number, then all others.

Queries are taken in blocks of about QUERY_BYTES, each a pass of its own; what a block sends to the tasks (its terms,
weights and kth scores) is bounded by that.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from hourgrid.llm import chunkcodes as C, textscan as S
from hourgrid.llm.scratch import Scratch, bound_batches

K = 20
BUCKET = 4096
FOCUS = 4
QUERY_BYTES = 8 << 20
#: Vectors of a partition, on average.
PART_ROWS = 65_536
#: Room for rounding in bounds.
SLACK = 1 + 1e-9

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_CAPITALS = {c: c + 32 for c in range(65, 91)}
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LAST = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[bytes]:
    return [t.encode() for t in _TERM.findall((text or "").translate(_CAPITALS))]


def term_spans(scan: S.Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all terms one after the other, in lower case; where each begins (and the end); the row of each."""
    inside = _INSIDE[scan.data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = scan.row_start[:-1][scan.row_start[:-1] < scan.row_start[1:]]
    first[edge] = inside[edge]
    start = np.flatnonzero(first)
    place = np.cumsum(inside) - 1
    data = S.lowered(S.Scan(scan.data[inside], np.zeros(1, np.int64))).data
    return data, np.append(place[start], len(data)), scan.row_of(start)


def _count_terms(parts: Iterator[pa.RecordBatch], number: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for at, scan in S.slices(part.column("__text"), 4 << 20):
            data, starts, row = term_spans(scan)
            words, which = C.distinct(data, starts)
            known = np.fromiter((number.get(w, -1) for w in words), np.int64, len(words))
            code = known[which]
            held = code >= 0
            record, tf = np.unique(row[held] * len(number) + code[held], return_counts=True)
            owner, code = record // max(len(number), 1), record % max(len(number), 1)
            edge = pa.array(np.searchsorted(owner, np.arange(scan.rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").slice(at, scan.rows), pa.array(S.per_row(row, scan.rows)),
                 pa.ListArray.from_arrays(edge, pa.array(code.astype(np.int32))), pa.ListArray.from_arrays(edge, pa.array(tf.astype(np.int64)))],
                ["doc_id", "n", "term", "tf"])


def _vectors(part: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, term and value of all entries of a batch."""
    lists = part.column("term")
    count = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    return np.repeat(np.arange(len(count)), count), np.asarray(lists.flatten()).astype(np.int64), np.asarray(part.column(name).flatten()).astype(np.int64)


def _impacts(parts: Iterator[pa.RecordBatch], documents: int, total: int, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part in parts:
        owner, term, tf = _vectors(part, "tf")
        m = 100 - 25 + (25 * part.column("n").to_numpy() * documents) // total
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[owner])
        length = np.sqrt(np.bincount(owner, impact.astype(np.float64) ** 2 * weight[term], part.num_rows))
        out = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(length), part.column("term"), pa.ListArray.from_arrays(part.column("term").offsets, pa.array(impact))],
                                         ["doc_id", "length", "term", "impact"])
        yield out.filter(pa.array(length > 0))


@dataclass
class Queries:
    """A block of queries: number, terms and their repeats; ``weight`` by term; ``kth`` the score to reach."""

    number: list[int]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]
    weight: np.ndarray
    kth: np.ndarray

    def __post_init__(self):
        self.length, self.focus, self.rest = [], [], []
        for terms, repeats in zip(self.terms, self.repeats):
            value = repeats * np.sqrt(self.weight[terms])
            heavy = np.argsort(-value, kind="stable")[:FOCUS]
            total = float(np.square(value).sum())
            self.length.append(math.sqrt(total))
            self.focus.append([(int(terms[i]), float(value[i])) for i in heavy])
            self.rest.append(math.sqrt(max(0.0, total - float(np.square(value[heavy]).sum()))))


class Best:
    """The k best (score, id) of a query so far."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]

    def kth(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 1


def _search(parts: Iterator[pa.RecordBatch], queries: Queries, k: int, visits: list | None = None) -> Iterator[pa.RecordBatch]:
    """The k best of the vectors of a task for each query, as far as they reach its kth score."""
    best = [Best(k) for _ in queries.number]
    kth = queries.kth.copy()
    length = np.array(queries.length)
    root = np.sqrt(queries.weight)
    for part in parts:
        for low in range(0, part.num_rows, BUCKET):
            bucket = part.slice(low, BUCKET)
            size = bucket.column("length").to_numpy()
            active = np.flatnonzero(length * size.max() * SLACK >= kth)
            if not len(active):
                continue
            ids = bucket.column("doc_id").cast(pa.int64()).fill_null(_LAST).to_numpy()
            owner, term, impact = _vectors(bucket, "impact")
            begin = np.searchsorted(owner, np.arange(len(size) + 1))
            by = np.argsort(term, kind="stable")
            column, rows, values = term[by], owner[by], impact[by] * root[term[by]]
            square = np.square(size)
            for q in active:
                product, spent = np.zeros(len(size)), np.zeros(len(size))
                for f, value in queries.focus[q]:
                    a, b = np.searchsorted(column, [f, f + 1])
                    product[rows[a:b]] += value * values[a:b]
                    spent[rows[a:b]] += np.square(values[a:b])
                reach = product + queries.rest[q] * np.sqrt(np.maximum(square * SLACK - spent, 0))
                left = np.flatnonzero(reach * SLACK >= kth[q])
                if visits is not None:
                    visits.append((int(q), len(left), len(size)))
                if not len(left):
                    continue
                factor = np.zeros(len(queries.weight), np.int64)
                factor[queries.terms[q]] = queries.repeats[q] * queries.weight[queries.terms[q]]
                count = begin[left + 1] - begin[left]
                at = C.spread(begin[left], count)
                sums = np.concatenate([[0], np.cumsum(factor[term[at]] * impact[at])])
                score = np.diff(sums[np.concatenate([[0], np.cumsum(count)])])
                hit = score >= kth[q]
                if hit.any():
                    best[q].add(score[hit], ids[left[hit]])
                    kth[q] = max(kth[q], best[q].kth())
    query = np.repeat(queries.number, [len(b.score) for b in best])
    ids = np.concatenate([b.id for b in best]) if best else np.zeros(0, np.int64)
    score = np.concatenate([b.score for b in best]) if best else np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int64)), pa.array(ids, mask=ids == _LAST), pa.array(score)], ["query", "doc_id", "score"])


def rank(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents with a score above 0 for every row of ``items``.

    ``docs`` has an integer doc_id and text, ``items`` item_id and text; other columns are not read.  Equal scores go by
    doc_id, null last.  A null text has no terms; an item without terms, or whose terms no document holds, gives no
    row.  Repeated document rows are documents of their own and may hold several ranks; every item row is
    ranked, so a repeated one gives its rows again.  An empty table gives an empty result.
    """
    spark = bound_batches(docs.sparkSession)
    scratch = Scratch(spark, "lexical")
    asked = scratch.save(items.select("item_id", "text").withColumn("query", F.monotonically_increasing_id()), "items")
    size = asked.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    found = None
    for block in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).select("query", "text").collect()  # about QUERY_BYTES
        held = _rank_block(scratch, docs, [(r["query"], r["text"]) for r in some], k, f"{block}")
        if held is not None:
            found = held if found is None else found.unionByName(held)
    if found is None:
        return spark.createDataFrame([], f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    return found.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def _best(df: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return df.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def _rank_block(scratch: Scratch, docs: DataFrame, items: list[tuple[int, str | None]], k: int, name: str) -> DataFrame | None:
    bags = [(q, bag) for q, bag in ((q, Counter(terms_of(t))) for q, t in items) if bag]
    number = {t: i for i, t in enumerate(sorted({t for _, bag in bags for t in bag}))}
    if not number:
        return None
    texts = docs.select("doc_id", F.col("text").alias("__text"))
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    counts = scratch.save(texts.mapInArrow(lambda parts: _count_terms(parts, number), f"doc_id {doc_type}, n long, term array<int>, tf array<long>"), f"counts-{name}")
    total = counts.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
    if not total["terms"]:
        return None
    documents, terms = total["documents"], total["terms"]
    df = np.zeros(len(number), np.int64)
    for r in counts.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # terms of the block
        df[r["term"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)

    vectors = counts.where(F.size("term") > 0).mapInArrow(lambda parts: _impacts(parts, documents, terms, weight), f"doc_id {doc_type}, length double, term array<int>, impact array<long>")
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-documents // PART_ROWS))
    ordered = vectors.repartitionByRange(parts, F.desc("length"), "doc_id").sortWithinPartitions(F.desc("length"), "doc_id")
    ordered = scratch.save(ordered.withColumn("part", F.spark_partition_id()), f"vectors-{name}")
    scratch.drop(f"counts-{name}")
    last = ordered.agg(F.max("part")).first()[0]
    if last is None:
        return None

    kth = np.ones(len(bags), np.int64)
    place = {q: i for i, (q, _) in enumerate(bags)}
    numbers = [np.array([number[t] for t in bag], np.int64) for _, bag in bags]
    repeats = [np.array(list(bag.values()), np.int64) for _, bag in bags]
    found, edges = None, sorted({0, 1, math.isqrt(last + 1) + 1, last + 1})
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
        queries = Queries([q for q, _ in bags], numbers, repeats, weight, kth)
        near = ordered.where((F.col("part") >= low) & (F.col("part") < high)).drop("part")
        held = _best(near.mapInArrow(lambda parts, queries=queries: _search(parts, queries, k), "query long, doc_id long, score long"), k).drop("rank")
        held = held if found is None else _best(held.unionByName(found), k).drop("rank")
        found = scratch.save(held, f"found-{name}-{i}")
        for r in found.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).collect():  # queries of the block
            kth[place[r["query"]]] = r["kth"]
    scratch.drop(f"vectors-{name}", *(f"found-{name}-{i}" for i in range(len(edges) - 2)))
    return _best(found, k)
