from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from hourgrid.llm import packing, queries
from tests.conftest import SMALL

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference_ids():
    coder = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    return lambda text: [*coder.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, out, ids, capacity=2048):
    """Pieces give back the documents, and sequences have neither gaps nor too many tokens."""
    want = Counter()
    for i, text in rows:
        t = ids(text)
        first = len(t) % capacity or min(len(t), capacity)
        at = [0, *range(first, len(t) + 1, capacity)]
        want.update((i, k, a, b - a, zlib.crc32(np.array(t[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(at[:-1], at[1:])))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query_packs_every_token(spark, reference_ids):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    out = queries.QUERIES["op10_best_two_fit_packing"](spark, SMALL).collect()
    used = check(rows, out, reference_ids)
    assert used <= 1.02 * sum(r["length"] for r in out) / 2048 + 1


def test_odd_rows(documents, cluttered, odd, reference_ids):
    rows = odd + [(20, "token " * 2047), (21, "token " * 2048), (22, "token " * 4095), (23, "<|endoftext|><|endoftext|>")] + [(24, "same")] * 500
    check(rows, packing.pack(cluttered(documents(*rows))).collect(), reference_ids)
    assert packing.pack(documents((1, "x")).limit(0)).collect() == []


def one_by_one(counts, capacity):
    """Best-two-fit a sequence at a time, all pairs tried."""
    left, out = counts.copy(), []
    while any(left.values()):
        gap, bin_ = capacity, []
        while fit := [x for x in left if left[x] and x <= gap]:
            bin_.append(max(fit))
            left[bin_[-1]] -= 1
            gap -= bin_[-1]
        room = gap + bin_[-1]
        pairs = [(a, b) for a in left for b in left if left[a] and left[b] and (a != b or left[a] > 1) and a + b <= room]
        best = max((a + b for a, b in pairs), default=0)
        if gap and best > bin_[-1]:
            left[bin_.pop()] += 1
            a, b = next(p for p in sorted(pairs) if sum(p) == best)
            left[a] -= 1
            left[b] -= 1
            bin_ += [a, b]
        out.append(tuple(sorted(bin_, reverse=True)))
    return Counter(out)


@pytest.mark.parametrize("seed", range(8))
def test_fillings_equal_one_sequence_after_the_other(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 40, rng.integers(1, 12))
    counts = np.zeros(41, np.int64)
    for x in lengths:
        counts[x] += rng.integers(1, 60)
    got = Counter()
    for bin_, repeat in packing.fillings(counts, 40):
        got[tuple(bin_)] += repeat
    assert got == one_by_one({int(x): int(counts[x]) for x in range(41) if counts[x]}, 40)


def test_two_fit_beats_the_greedy_filling():
    counts = np.zeros(11, np.int64)
    for x in (6, 3, 2, 2):
        counts[x] += 1
    assert packing.fillings(counts, 10)[0] == ([6, 2, 2], 1)


def test_long_white_space(documents, reference_ids):
    rows = [(1, "a" + " " * 4_000_000 + "b"), (2, "\n" * 300_000), (3, "\t" * 300_000 + "end")]
    check(rows, packing.pack(documents(*rows)).collect(), reference_ids)


def test_words_of_a_task_are_encoded_once():
    coder = packing.default_coder()
    words = [b" " + bytes(97 + (n // 26**k) % 26 for k in range(4)) for n in range(100_000)]
    calls, word = [0], coder.word

    def counted(text):
        calls[0] += 1
        return word(text)

    coder.word = counted
    first = coder.of(words)
    assert coder.of(words) == first and calls[0] == len(words)


def test_words_have_the_ids_of_the_tokenizer(reference_ids):
    word = packing.default_coder().word
    for text in ("the", " the", " Zyxwvq", "a", " é", " naïve", "Øre"):
        assert [*word(text), 0] == reference_ids(text)
