from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from hourgrid.llm import alignment, chunkcodes, queries
from tests.conftest import SMALL

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokens():
    """A and B tokens of a text as (id, bytes), or none where they do not spell it."""
    a = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    alphabet = chunkcodes.byte_alphabet()

    def a_bytes(i):
        return b"<|endoftext|>" if i == 50256 else bytes(alphabet[c] for c in a.id_to_token(i))

    def b_bytes(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def of(text):
        if not text:
            return [], []
        left = [(i, a_bytes(i)) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, b_bytes(i)) for i in b.encode(text)]
        want = (" " + text).encode()
        return (left, right) if all(b"".join(t for _, t in x) == want for x in (left, right)) else ([], [])
    return of


def brute(texts, tokens):
    links, out = [], []
    for text in texts:
        left, right = tokens(text)
        spans = []
        for side in (left, right):
            at = 0
            spans.append([(i, at, at := at + len(t)) for i, t in side])
        found = [(i, j) for i, s, e in spans[0] for j, x, y in spans[1] if s < y and x < e] if len(left) < 400 else sweep(*spans)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, todo = [], [iter([*side, (None, 1 << 60, 0)]) for side in spans]
        ahead = [next(t) for t in todo]
        for e in ends:
            parts = []
            for k, t in enumerate(todo):
                parts.append([])
                while ahead[k][1] < e:
                    parts[-1].append(str(ahead[k][0]))
                    ahead[k] = next(t)
            groups.append("|".join(map(",".join, parts)))
        out.append((len(left), len(right), len(ends), len(found), hashlib.sha256(";".join(groups).encode()).hexdigest() if left else ""))
        links.append(found)
    count = Counter(p for found in links for p in found)
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return count, [(*o[:4], sum(count[p] == best[p[1]] for p in found), sum(count[p] for p in found), o[4]) for o, found in zip(out, links)]


def sweep(left, right):
    i = j = 0
    out = []
    while i < len(left) and j < len(right):
        out.append((left[i][0], right[j][0]))
        e, y = left[i][2], right[j][2]
        i, j = i + (e <= y), j + (y <= e)
    return out


HARD = ["▁a ▁", "foo▁ bar", "<s> </s> <unk> <0x41>", "a  b   c", " x", "tab\tand\nline\r\n  x", "ﬁ½ x　y 🙂🙂", "<|endoftext|> <|endoftext|>", "1234567890 3.14", "naïve café’s", "\x00\x01 z"]


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, documents, cluttered, odd, tokens, monkeypatch, small):
    if small:  # many batches, frames and parts
        for name, value in (("FRAME", 3), ("PART_BYTES", 1500), ("BATCH_BYTES", 60)):
            monkeypatch.setattr(alignment, name, value)
    rows = [r for r in odd if len(r[1] or "") < 1000] + [(100 + i, t) for i, t in enumerate(HARD)] + [(200, "the same text")] * 30
    docs = cluttered(documents(*rows))
    found = alignment.align(docs)
    count, want = brute([t for _, t in rows], tokens)
    got = Counter(tuple(r) for r in found.documents.collect())
    assert got == Counter((i, *w) for (i, _), w in zip(rows, want))
    assert {(r["a_id"], r["b_id"]): r["n"] for r in found.pairs.collect()} == dict(count)


def test_query(spark, tokens):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    _, want = brute([r["text"] for r in rows], tokens)
    out = queries.QUERIES["op12_cross_tokenizer_alignment"](spark, SMALL)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(r) for r in out.collect()) == sorted((r["doc_id"], *w) for r, w in zip(rows, want))


def test_long_texts_and_empty_table(documents, tokens):
    texts = ["word " * 30000, "x" * 50000, "a" + " " * 200_000 + "b"]
    _, want = brute(texts, tokens)
    got = alignment.align(documents(*enumerate(texts))).documents.orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == want
    empty = alignment.align(documents((1, "x")).limit(0))
    assert empty.documents.collect() == [] and empty.pairs.collect() == []


@pytest.mark.parametrize("frame", [1, 4, 1000])
def test_merge_equals_a_plain_count(monkeypatch, frame):
    monkeypatch.setattr(alignment, "FRAME", frame)
    rng = np.random.default_rng(frame)
    runs, want = [], Counter()
    for _ in range(9):
        record = np.unique(rng.integers(0, 40 * 300, 200))
        pair, row, times = (record // 300).astype(np.uint64) << np.uint64(31), record % 300 * (1 + 300 * (frame == 4)), rng.integers(1, 400, len(record))
        runs.append(alignment._frames(pair, row, times))
        for p, t in zip(pair.tolist(), times.tolist()):
            want[p] += t
        run, rows = alignment.Run(runs[-1]), []
        while run.next():
            rows += run.rows().tolist()
        assert rows == row.tolist()
    pair, total = alignment.merge_counts(runs)
    assert pair.tolist() == sorted(want) and total.tolist() == [want[p] for p in sorted(want)]
    assert len(alignment.merge_counts([])[0]) == 0
