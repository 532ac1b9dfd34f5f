from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from hourgrid.llm import chunks, textscan as S


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))


def test_gear_equals_a_plain_loop():
    texts = [b"some text here", b"", b"z" * 70, bytes(range(32, 120))]
    data = np.frombuffer(b"".join(texts), np.uint8)
    start = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want = []
    for t in texts:
        h = 0
        for b in t:
            h = (h * 2 + int(chunks._GEAR[b])) & 0xFFFFFFFF
            want.append(h)
    assert chunks.gear_hash(data, start).tolist() == want


def test_chunks_cover_every_text_and_resist_insertions():
    rng = random.Random(1)
    text = words(rng, 600)
    moved = text[:900] + "INSERTED " + text[900:]
    cut = []
    for _, scan in S.slices(pa.array([text, moved, "", "é🙂" * 40])):
        a, b = chunks.boundaries(scan)
        raw = scan.data.tobytes()
        for lo, hi in zip(scan.row_start[:-1], scan.row_start[1:]):
            mine = [raw[x:y] for x, y in zip(a, b) if lo <= x < hi]
            assert b"".join(mine) == raw[lo:hi]
            cut.append(mine)
    assert len(set(cut[1]) - set(cut[0])) <= 4
    assert 20 < len(text) / len(cut[0]) < 60


def test_repeats_are_found_and_clean_texts_left_alone(documents, cluttered):
    rng = random.Random(5)
    passage, other = words(rng, 60), words(rng, 55)
    rows = [(i, words(rng, 120)) for i in range(40)]
    rows += [(100, words(rng, 30) + " " + passage + " " + words(rng, 30)), (101, passage), (102, words(rng, 200) + " " + passage), (103, other + "\n" + words(rng, 50)), (104, words(rng, 9) + other)]
    rows += [(110 + i, passage + " " + words(rng, 20)) for i in range(50)]
    found = chunks.repeated_passages(cluttered(documents(*rows))).collect()
    assert {r["doc_id"] for r in found} == {100, 101, 102, 103, 104, *range(110, 160)}
    text = dict(rows)
    for r in found:
        run = text[r["doc_id"]][r["start"]: r["end"]]
        assert r["kept"] == (r["doc_id"] == r["first_doc_id"])
        assert any(run[k: k + 20] in text[r["first_doc_id"]] for k in range(0, len(run), 20))
    left = {r["doc_id"]: r["text"] for r in chunks.drop_repeats(documents(*rows), chunks.repeated_passages(documents(*rows))).collect()}
    assert left[100] == text[100] and left[5] == text[5]
    assert len(left[102]) < len(text[102]) - 200 and left[102][:150] == text[102][:150]
    assert sum(passage[70:220] in t for t in left.values()) == 1


def test_odd_rows(documents, odd):
    found = chunks.repeated_passages(documents(*odd)).collect()
    assert found == []
    rows = [(1, "ab " * 4000), (2, "ab " * 3000 + "end"), (3, None), (4, ""), (None, "ab " * 4000)]
    assert {r["doc_id"] for r in chunks.repeated_passages(documents(*rows)).collect()} == {1, 2}
    assert chunks.repeated_passages(documents((1, "x")).limit(0)).collect() == []
    back = chunks.drop_repeats(documents(*odd), chunks.repeated_passages(documents(*odd)))
    assert sorted(map(str, back.collect())) == sorted(map(str, documents(*odd).collect()))


@pytest.mark.parametrize("length", [50, 200])
def test_repeated_rows_are_one_document(documents, length):
    text = words(random.Random(length), length)
    assert chunks.repeated_passages(documents((7, text), (7, text))).collect() == []
