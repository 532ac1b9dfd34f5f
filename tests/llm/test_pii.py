from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from hourgrid.llm import crf, pii, queries
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def field():
    return pii.fit_field(pii.labelled_examples())


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("0123459..@@+--() aZ_é\n"), max_size=60))
def test_patterns_equal_regular_expressions(text):
    assert pii.pattern_spans(text) == brute(text)


def test_patterns_on_known_texts():
    text = "a@b.c x@y 1.2.3.4.5.6.7.8 256.1.1.1 4539 1488 0343 6467 +1 (988) 555-2485. +12 a.b@c@d.e 4539148803436468"
    assert pii.pattern_spans(text) == brute(text)
    assert pii.luhn("4539148803436467") and not pii.luhn("4539148803436468")
    for long in ("a" * 200000, "1" * 200000, "a.b" * 60000 + "@", "+1" + "(" * 200000, "1." * 100000):
        pii.pattern_spans(long)


def test_the_field_adds_other_written_forms(field):
    for text, span in {"call (988) 555-2485 now": "(988) 555-2485", "mail john.doe [at] mail.example.com today": "john.doe [at] mail.example.com",
                       "card 4539.1488.0343.6467 ok": "4539.1488.0343.6467", "or 988-555-2485.": "988-555-2485"}.items():
        (start, _, end, base), = pii._all_spans(field, [text])[0]
        assert text[start:end] == span and not base


def test_the_field_leaves_clean_text_alone(field):
    for text in ("on 2024-01-05 at 12:30 we had 3,400 of 2.0.1", "Licensed under the Apache License, Version 2.0.", "password=7602ad27cf5550de1c and token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\"",
                 "room 12 | 14 | 15", "plain words only", "4539148803436468 is no card"):
        assert pii._all_spans(field, [text]) == [[]]


def test_held_out_examples(field):
    fresh = pii.labelled_examples(300, 99)
    paths = field.decode([pii._features(w) for w, _ in fresh])
    assert np.mean([[field.tags[k] for k in p] == t for p, (_, t) in zip(paths, fresh)]) > 0.95


def test_decoding_equals_all_paths():
    rng = np.random.default_rng(4)
    tags = ["O", "B", "I"]
    chain = crf.Chain(tags, {f"f{i}": i for i in range(6)}, np.vstack([rng.normal(size=(6, 3)), np.zeros((1, 3))]), rng.normal(size=(3, 3)), rng.normal(size=3))
    sequences = [[[f"f{rng.integers(8)}" for _ in range(rng.integers(1, 4))] for _ in range(n)] for n in (1, 4, 5, 2, 5, 3)]

    def score(s, path):
        total = chain.begin[path[0]]
        for t, p in enumerate(path):
            total += sum(chain.weight[chain.index.get(f, 6), p] for f in s[t]) + (chain.step[path[t - 1], p] if t else 0)
        return total

    for s, path in zip(sequences, chain.decode(sequences)):
        assert tuple(path) == max(itertools.product(range(3), repeat=len(s)), key=lambda p: score(s, p))
    assert [len(p) for p in chain.decode([[], [["f1"]]])] == [0, 1]
    assert crf.train([], [], tags).decode([[["x"], ["y"]]])[0].tolist() == [0, 0]


def test_training_climbs():
    sequences, labels = [[["a"], ["b"]], [["b"], ["a"]], [["a"], ["a"]]] * 5, [["O", "B"], ["B", "O"], ["O", "O"]] * 5
    chain = crf.train(sequences, labels, ["O", "B"])
    assert [[chain.tags[k] for k in p] for p in chain.decode(sequences)] == labels


def test_rows_and_redaction(documents, cluttered, odd, field):
    rows = odd + [(30, "write to a.b@mail.example.com or +1 (988) 555-2485 🙂 1.2.3.4"), (31, "1 " * 20000 + "x@y.z")]
    df = cluttered(documents(*rows))
    found = {(r["doc_id"], tuple((s["kind"], s["start"], s["end"], s["base"]) for s in r["spans"])) for r in pii.find_personal_data(df, field).collect()}
    text = dict(rows)
    for i, spans in found:
        if i is not None:
            assert [(a, pii.KINDS.index(k), b) for k, a, b, base in spans if base] == brute(text[i] or "")
    clean = pii.redact(df, field)
    assert clean.columns == df.columns
    got = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert got[30] == "write to [EMAIL] or [PHONE] 🙂 [IP]" and got[1] is None and got[7] == text[7]
    assert pii.find_personal_data(df.limit(0), field).collect() == []


def test_query_digests(spark):
    out = {r["doc_id"]: r for r in queries.QUERIES["op6_personal_data"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        base, r = brute(d["text"]), out[d["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in base) for i in range(4)]
        assert {f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base} <= set(r["spans"].split(","))


def test_long_runs_of_digits():
    long = "x 1.2.3." + "0" * 5000
    assert pii.pattern_spans(long) == [(2, 1, len(long))]
    assert pii.pattern_spans("1.2.3." + "9" * 5000) == [] and pii.pattern_spans("0" * 6000 + "1.2.3.4 +" + "1" * 9000)[0][1] == 1
