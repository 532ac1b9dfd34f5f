from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from hourgrid.llm import components, neardup, queries
from hourgrid.llm.scratch import Scratch
from tests.conftest import SMALL

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) of all rows with an id, over all pairs."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            both = len(x & y)
            if both and 100 * both >= 75 * (len(x) + len(y) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(s), least[find(k)], i == least[find(k)]) for k, (i, s) in enumerate(sets))


def result(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect() if r["doc_id"] is not None)


def variants(rng, words, n, share):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(int(rng.random() * share * len(w))):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


def corpus(seed, per_group=25):
    rng = random.Random(seed)
    texts = []
    for length in (3, 6, 9, 14, 40, 80, 160, 400):
        base = [f"v{rng.randrange(3000)}" for _ in range(length)]
        texts += variants(rng, base, per_group, 0.12)
    line = " ".join(f"common{i}" for i in range(14))
    texts += [line + " " + " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(3, 30))) for _ in range(60)]
    texts += [line] * 5
    rng.shuffle(texts)
    return [(1000 - i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed, small, block", [(1, 8, 256), (2, 2, 5)])
def test_equals_brute_force(documents, monkeypatch, seed, small, block):
    monkeypatch.setattr(neardup, "SMALL_LIST", small)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = corpus(seed)
    assert result(documents(*rows)) == brute(rows)


def test_ids_by_shuffle(documents, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    rows = corpus(3, 8)
    assert result(documents(*rows)) == brute(rows)


def test_odd_rows(documents, cluttered, odd):
    rows = odd + [(11, "same words here again"), (12, "a b c d e"), (13, "A B c D e"), (14, "a b c d e f"), (15, "a b c d"), (16, "a  b\nc d")]
    df = cluttered(documents(*rows))
    assert result(df) == brute(rows)
    lone = [r for r in neardup.near_duplicates(df).collect() if r["doc_id"] is None]
    assert [(r["component_id"], r["kept"]) for r in lone] == [(None, True)]
    assert neardup.near_duplicates(df.limit(0)).collect() == []
    blank = documents((3, None), (2, ""), (1, " "))
    assert result(blank) == Counter([(3, 0, 3, True), (2, 0, 2, True), (1, 0, 1, True)])


def test_one_id_with_different_texts(documents):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "totally different words in this other text"), (3, "totally different words in this other text")]
    assert result(documents(*rows)) == Counter([(1, 4, 1, True), (2, 4, 1, False), (2, 3, 2, True), (3, 3, 2, False)])


def test_similarity_is_exact_at_the_border():
    a = np.arange(0, 700, dtype=np.int64) * 7919
    for shared, linked in ((600, True), (599, False)):  # 600 of 800 is 0.75
        b = np.sort(np.concatenate([a[:shared], 10 ** 9 + np.arange(700 - shared)]))
        assert neardup.similar(np.sort(a), b) is linked
    sets = [np.sort(np.random.default_rng(i).choice(60, 30, replace=False)).astype(np.int64) for i in range(9)]
    assert neardup._shared(sets).tolist()[0][1:] == [len(np.intersect1d(sets[0], s)) for s in sets[1:]]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(10, 60)] + [(3, 7), (500, 500), (1000, 999)]
    found = components.components(Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long"), "t").collect()
    got = {r["node"]: r["root"] for r in found}
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 3 for i in range(10, 60)}, 7: 3, 1000: 999}
    assert components.components(Scratch(spark, "test"), spark.createDataFrame([], "a long, b long"), "t").collect() == []


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in queries.QUERIES["op7_minhash_near_dedup"](spark, SMALL).collect())
    assert got == brute(rows)


def test_regular_texts_that_share_nothing_stay_apart(documents, rows):
    words = [" ".join(f"{'ab'[(bin(i).count('1') & 1) ^ k]} u{i}" for i in range(4096)) for k in (0, 1)]
    lengths = [" ".join("ab"[(bin(i).count("1") & 1) ^ k] for i in range(4096)) for k in (0, 1)]  # the same few shingles
    data = list(enumerate(words + lengths))
    assert Counter(rows(neardup.near_duplicates(documents(*data)), "doc_id", "n_shingles", "component_id", "kept")) == brute(data)
