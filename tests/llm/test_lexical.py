from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hourgrid.llm import lexical, queries
from tests.conftest import SMALL


def brute(docs, items, k=20):
    """(item_id, rank, doc_id, score) as the formula says, every document scored."""
    bags = [(i, Counter(lexical.terms_of(t))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            if not bag:
                continue
            m = 75 + 25 * sum(bag.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * bag[t] // (1000 * bag[t] + 12 * m)) for t in lexical.terms_of(text) if t in bag)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def test_terms():
    assert lexical.terms_of("Ab1 cd,É漢字-x_y\x7fz 'ÄB") == [t.encode() for t in ["ab1", "cd", "É漢字", "x", "y", "z", "Äb"]]
    assert lexical.terms_of(None) == [] and lexical.terms_of(" ,\n") == []
    texts = ["Ab1 cd", "", None, "x", "Y,y", "é"]
    for _, scan in lexical.S.slices(pa.array(texts), 4):
        data, starts, row = lexical.term_spans(scan)
        assert [bytes(data[a:b]) for a, b in zip(starts[:-1], starts[1:])] == [t for i in range(scan.rows) for t in lexical.terms_of(
            bytes(scan.data[scan.row_start[i]: scan.row_start[i + 1]]).decode())]


@pytest.mark.parametrize("shape", [(4096, 65_536, 1 << 20), (3, 4, 60)])
def test_odd_rows_ties_and_blocks(spark, documents, cluttered, odd, monkeypatch, shape):
    for name, value in zip(("BUCKET", "PART_ROWS", "QUERY_BYTES"), shape):
        monkeypatch.setattr(lexical, name, value)
    rows = odd + [(100 + i, "alpha beta gamma " * (1 + i % 3) + f"rare{i % 7}") for i in range(60)] + [(500, "alpha only")] * 25 + [(None, "alpha only")]
    items = [(1, "alpha only"), (2, "Same words again same"), (3, None), (4, "nowhere"), (5, ""), (1, "rare3 rare4 gamma ONE"), (None, "word x"), (7, "rare3 漢字 © end"), (8, "alpha only")]
    out = lexical.rank(cluttered(documents(*rows)), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows, items)


def test_query_and_pruning(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    out = queries.QUERIES["op11_lexical_search"](spark, SMALL)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(docs, items)
    assert dict(out.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_empty_tables(spark, documents):
    some, items = documents((1, "a b")), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank(some.limit(0), items).collect() == []
    assert lexical.rank(some, items.limit(0)).collect() == []
    assert lexical.rank(documents((1, None), (2, " ")), items).collect() == []
    assert lexical.rank(some, spark.createDataFrame([(1, "zzz")], "item_id long, text string")).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_buckets_skip_documents_and_lose_none(seed):
    rng = np.random.default_rng(seed)
    n, terms = 3000, 60
    weight = rng.integers(0, 9000, terms)
    vectors = [(np.sort(rng.choice(terms, rng.integers(1, 12), replace=False)), None) for _ in range(n)]
    vectors = [(t, rng.integers(1, 10 ** 6, len(t))) for t, _ in vectors]
    length = np.array([math.sqrt((v.astype(float) ** 2 * weight[t]).sum()) for t, v in vectors])
    order = np.argsort(-length)
    at = pa.array(np.concatenate([[0], np.cumsum([len(vectors[i][0]) for i in order])]), pa.int32())
    batch = pa.RecordBatch.from_arrays([pa.array(order), pa.array(length[order]), pa.ListArray.from_arrays(at, pa.array(np.concatenate([vectors[i][0] for i in order]), pa.int32())),
                                        pa.ListArray.from_arrays(at, pa.array(np.concatenate([vectors[i][1] for i in order])))], ["doc_id", "length", "term", "impact"])
    chosen = [rng.choice(terms, 6, replace=False) for _ in range(4)]
    asked = lexical.Queries(list(range(4)), chosen, [rng.integers(1, 3, 6) for _ in range(4)], weight, np.ones(4, np.int64))
    lexical_bucket, lexical.BUCKET = lexical.BUCKET, 100
    try:
        visits = []
        out = next(lexical._search(iter([batch]), asked, 5, visits))
    finally:
        lexical.BUCKET = lexical_bucket
    for q in range(4):
        factor = np.zeros(terms, np.int64)
        factor[asked.terms[q]] = asked.repeats[q] * weight[asked.terms[q]]
        score = np.array([int((factor[t] * v).sum()) for t, v in vectors])
        want = sorted(zip(-score, range(n)))[:5]
        got = [(r["score"], r["doc_id"]) for r in out.to_pylist() if r["query"] == q]
        assert got == [(-s, i) for s, i in want]
    assert sum(left for _, left, _ in visits) < 0.5 * 4 * n
