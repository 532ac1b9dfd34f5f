"""The vectorised scan next to regular expressions and dictionaries."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from hourgrid.llm import textscan as S
from tests.llm.conftest import ODD

WORD = re.compile("[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAbB \t\n\x0b\r.é漢🙂\x00"), max_size=30)), max_size=12)


def spans(texts, limit):
    for first, scan in S.slices(pa.array(texts, pa.string()), limit):
        yield texts[first: first + scan.rows], scan


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 60))
def test_words_and_lines(texts, limit):
    got_words, got_lines, count = [], [], 0
    for part, scan in spans(texts, limit):
        raw = scan.data.tobytes()
        for (start, end, row), out in ((scan.words(), got_words), (scan.lines(), got_lines)):
            lists = [[] for _ in part]
            for a, b, r in zip(start, end, row):
                lists[r].append(raw[a:b].decode())
            out += lists
        count += scan.rows
    assert count == len(texts)
    assert got_words == [WORD.findall(t or "") for t in texts]
    assert got_lines == [(t or "").split("\n") for t in texts]


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 60), st.integers(1, 60))
def test_hashes_depend_on_the_bytes_alone(texts, a, b):
    def hashes(limit):
        out = []
        for _, scan in spans(texts, limit):
            start, end, _ = scan.words()
            raw = scan.data.tobytes()
            out += [(raw[i:j], int(h)) for i, j, h in zip(start, end, scan.hash_of(start, end))]
        return out
    one, other = hashes(a), hashes(b)
    assert one == other
    assert len({w for w, _ in one}) == len({h for _, h in one})


def test_slices_of_sliced_columns_and_nulls():
    texts = [t for _, t in ODD]
    whole = pa.array(["skip", *texts, "skip"], pa.string()).slice(1, len(texts))
    got = [s.data[a:b].tobytes().decode() for _, s in S.slices(whole, 50) for a, b in zip(s.row_start[:-1], s.row_start[1:])]
    assert got == [t or "" for t in texts]
    assert list(S.slices(pa.array([], pa.string()))) == []
    assert list(S.slices(pa.chunked_array([], pa.string()))) == []


def test_windows_stay_in_their_row():
    digest, row = np.arange(1, 8, dtype=np.uint64), np.array([0, 0, 0, 1, 1, 2, 2])
    _, first = S.windows(digest, row, 2)
    assert first.tolist() == [0, 1, 3, 5]
    assert S.windows(digest[:1], row[:1], 2)[0].size == 0


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


def test_regular_spans_do_not_collide():
    for n in (1024, 4096, 1 << 15):
        one, two = ("".join("ab"[t ^ k] for t in thue_morse(n)) for k in (0, 1))
        scan = S.Scan(np.frombuffer((one + two).encode(), np.uint8), np.array([0, n, 2 * n]))
        assert len(set(scan.hash_of(scan.row_start[:-1], scan.row_start[1:]).tolist())) == 2
        values = scan.data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        assert len(set(S.sequence_hash(values, scan.row_start).tolist())) == 2


def test_hash_is_the_polynomial(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 300).astype(np.uint8)
    start, end = np.array([0, 7, 7, 100, 299]), np.array([300, 7, 40, 290, 300])
    want = []
    for a, b in zip(start, end):
        parts = [sum((int(v) + 1) * pow(base, i, p) for i, v in enumerate(data[a:b])) % p for p, base in S._PRIMES]
        want.append(int(S.mix(np.array([(parts[0] << 31) + parts[1]], np.uint64) + S.mix(np.array([b - a], np.uint64)))[0]))
    for limit in (1 << 24, 10):
        monkeypatch.setattr(S, "_SUM_BYTES", limit)
        assert S.Scan(data, np.array([0, 300])).hash_of(start, end).tolist() == want
