from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from hourgrid.llm import chunkcodes, idstore, queries
from hourgrid.llm.perfecthash import PerfectHash
from hourgrid.llm.textscan import slices
from tests.conftest import SMALL

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def plain_ids():
    coder = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    return lambda text: coder.encode(text or "", add_special_tokens=False).ids


HARD = ["", " \t\n", "  a  b  ", "x" * 2000, "ünï © 漢字 🙂   \x00 end", "<|endoftext|> &amp; +1 (", "foo  <|endoftext|> bar  x  y 　z  é  à b", "it's 's ''s ' s  a\n b\n\n c",
        "a" + " " * 5000 + "b", "foo \n", "\n\nfoo", " lead", "x\u0085 y", "  a  b"]


def coded(texts, coder):
    out = []
    for _, scan in slices(pa.array(texts), 1 << 16):
        ids, at = chunkcodes.encode_rows(coder, scan.data, scan.row_start)
        out += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    return out


def test_stretches_give_the_ids_of_whole_texts(plain_ids):
    rng = np.random.default_rng(5)
    letters = [*" \n\tab'sé 　漢1.,<|\x1c\x85 ", "<|endoftext|>", "  ", "'ll"]
    texts = HARD + ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(3000)]
    assert coded(texts, chunkcodes.default_coder()) == [plain_ids(t) for t in texts]


def test_what_is_kept_stays_bounded(monkeypatch, plain_ids):
    monkeypatch.setattr(chunkcodes, "KEPT", 50)
    coder = chunkcodes.default_coder()
    texts = [" ".join(f"word{i + j}" for j in range(40)) for i in range(0, 400, 7)]
    assert coded(texts * 2, coder) == [plain_ids(t) for t in texts] * 2
    assert len(coder.young) <= 50 and len(coder.old) <= 50


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000, 50_000])
def test_perfect_hash_is_minimal(n):
    keys = np.random.default_rng(n).integers(0, 1 << 62, n).astype(np.uint64)
    table = PerfectHash.build(np.unique(keys))
    assert sorted(table.number(np.unique(keys)).tolist()) == list(range(len(np.unique(keys))))
    assert len(table.bits) * 8 <= 8 * n + 64


def test_perfect_hash_refuses_equal_keys():
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([3, 3], np.uint64))


def expected(rows, plain_ids):
    """(start, ids) by key, for rows with distinct keys or equal texts under one key."""
    at, out = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*plain_ids(text), 0], "<u4")
        out.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query(spark, plain_ids):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    out = queries.QUERIES["op13_perfect_hash_ids"](spark, SMALL)
    assert sorted(tuple(r) for r in out.collect()) == expected(rows, plain_ids)
    assert dict(out.dtypes) == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}


def test_odd_rows_one_key_in_many_shards_and_keyed_access(spark, documents, cluttered, odd, monkeypatch, plain_ids):
    monkeypatch.setattr(idstore, "SHARD_BYTES", 2000)
    monkeypatch.setattr(idstore, "BUCKET_KEYS", 8)
    rows = [r for r in odd if r[0] != 5 and len(r[1] or "") < 1000] + [(5, "same words here again today")] * 400 + [(i, f"text {i}") for i in range(100, 200)]
    docs = cluttered(documents(*rows))
    store = idstore.write_ids(docs)
    out = idstore.read_ids(spark, store, docs, payload=True).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) for r in out) == [
        (k is not None, k or 0, *rest) for k, *rest in expected(rows, plain_ids)]
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["n_tokens"] for r in out)
    assert len({r["shard"] for r in out if r["doc_id"] == 5}) > 1
    store = idstore.open_store(store.root)
    for key, copies in ((5, 400), (None, 1), (150, 1), (1, 1)):
        text = next(t for k, t in rows if k == key)
        assert [a.tolist() for a in idstore.get(store, key)] == [[*plain_ids(text), 0]] * copies
    assert idstore.get(store, 12345) == [] and idstore.get(store, -1) == []
    some = spark.createDataFrame([(5,), (150,), (150,), (99999,)], "doc_id long")
    assert idstore.read_ids(spark, store, some).groupBy("doc_id").count().orderBy("doc_id").collect() == [(5, 400), (150, 1)]


def test_empty_table_and_long_texts(spark, documents, plain_ids):
    empty = documents((1, "x")).limit(0)
    store = idstore.write_ids(empty)
    assert idstore.read_ids(spark, store, documents((1, "x"))).collect() == [] and idstore.get(store, 1) == []
    rows = [(7, "word " * 30000), (8, "x" * 200000), (9, "a" + " " * 1_000_000 + "b"), (10, "\n" * 300_000)]
    store = idstore.write_ids(documents(*rows))
    assert sorted(tuple(r)[:1] + tuple(r)[2:] for r in idstore.read_ids(spark, store, documents(*rows)).collect()) == expected(rows, plain_ids)


def test_ids_wider_than_the_vocabulary_are_refused(documents):
    with pytest.raises(Exception, match="do not fit"):
        idstore.write_ids(documents((1, "漢字 words")), make=lambda: chunkcodes.ChunkCoder(lambda ts: [[70000] for _ in ts], np.full(70001, -1)))
