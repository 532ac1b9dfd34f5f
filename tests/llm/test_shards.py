from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

from hourgrid.llm import numbering, shards
from hourgrid.llm.scratch import Scratch


@pytest.mark.parametrize("size", [1, 2, 3, 5, 17, 64, 65, 1000, 4097])
def test_permutation_and_its_inverse(size):
    order = shards.Permutation(size, 5)
    place = order.place(np.arange(size))
    assert sorted(place.tolist()) == list(range(size))
    assert order.row(place).tolist() == list(range(size))


def test_permutation_equals_plain_integers():
    order, size, mask = shards.Permutation(3001, 9), 3001, (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    half = 6

    def once(x):
        a, b = x >> half, x & 63
        for key in map(int, order.keys):
            a, b = b, a ^ (mix(b + key & mask) & 63)
        return a << half | b

    def place(x):
        x = once(x)
        while x >= size:
            x = once(x)
        return x

    assert order.place(np.arange(size)).tolist() == [place(i) for i in range(size)]


def test_seeds_differ_and_shuffle():
    a, b = shards.Permutation(5000, 1).place(np.arange(5000)), shards.Permutation(5000, 2).place(np.arange(5000))
    assert (a == b).mean() < 0.01
    assert abs(np.corrcoef(np.arange(5000), a)[0, 1]) < 0.06


def test_rows(documents, cluttered, odd):
    rows = odd + [(100 + i, f"text {i % 7}") for i in range(300)] + [(5, "same words here again today")] * 40
    out = [r.asDict() for r in shards.shard_rows(cluttered(documents(*rows))).collect()]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes = Counter(r["shard"] for r in out)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    assert {r["law"] for r in out} == {"rows"} and {r["grown_shard"] for r in out} == {None}
    assert shards.shard_rows(documents((1, "x")).limit(0)).collect() == []


def test_same_places_however_partitioned(documents):
    df = documents(*[(i * 7 % 501, str(i)) for i in range(501)])
    one, other = ({r["doc_id"]: (r["shard"], r["slot"]) for r in shards.shard_rows(d).collect()} for d in (df.repartition(1), df.repartition(9, "text")))
    assert one == other


def test_numbers_have_no_gaps_and_follow_the_order(spark, monkeypatch):
    monkeypatch.setattr(numbering, "RUN", 7)
    df = spark.createDataFrame([(i % 10, "a") for i in range(95)] + [(None, "z")] * 3 + [(3, "b")] * 50, "k int, v string")
    out = sorted(numbering.number_rows(Scratch(spark, "test"), df, ["k", "v"]).collect(), key=lambda r: r["row_number"])
    assert [r["row_number"] for r in out] == list(range(148))
    keys = [(r["k"] is not None, r["k"] or 0, r["v"]) for r in out]
    assert keys == sorted(keys)
