from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from hourgrid.llm import mixing, neardup, packing, pii, quality
from tests.conftest import SMALL


def test_stages_one_by_one(spark, tmp_path):
    import corpus_pipeline as P
    from tests.llm.test_neardup import brute

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept, tables = docs, []
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, kept, SMALL).write.parquet(f"{tmp_path}/{i}")
        kept = spark.read.parquet(f"{tmp_path}/{i}")
        tables.append(kept)
        if i < len(P.STAGES) - 1:
            assert kept.schema == docs.schema
    first, second, third, fourth, last = (t.collect() for t in tables)

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert len({r["doc_id"] for r in first} & set(good)) >= 0.97 * len(good)
    assert len(first) < docs.count()
    want = {i for i, _, _, kept in brute([(r["doc_id"], r["text"]) for r in first]) if kept}
    assert {r["doc_id"] for r in second} == want and len(second) == len(want)
    for r in third:
        assert not pii.pattern_spans(r["text"]) and r["n_chars"] == len(r["text"])
    assert {r["doc_id"] for r in fourth} <= {r["doc_id"] for r in third}
    lengths = Counter(r["doc_id"] for r in fourth)
    assert Counter(r["doc_id"] for r in last if r["piece"] == 0) == lengths
    assert Counter(map(tuple, P.run(spark, SMALL).select("doc_id", "piece", "length", "ids_crc32").collect())) == Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in last)


def test_stages_on_odd_rows(spark, documents, cluttered, odd):
    import corpus_pipeline as P

    for df in (cluttered(documents(*odd)).withColumn("mix_tokens", F.lit("mine")).withColumn("predicted", F.lit(3)), documents(*odd).limit(0)):
        for i, (_, stage) in enumerate(P.STAGES):
            columns, df = df.columns, stage(spark, df, SMALL)
            assert i == len(P.STAGES) - 1 or df.columns == columns
            assert i or [r for r in df.take(1) if "mix_tokens" in columns and r["mix_tokens"] != "mine"] == []
        df.collect()


def test_one_row_of_each_group_stays(spark, documents):
    import corpus_pipeline as P

    text = "a text of some words that stands here more than once"
    rows = [(3, text), (3, text), (5, text), (None, text), (None, text), (8, "another text of words that nobody repeats"), (9, None), (9, None)]
    left = P.near_duplicates(spark, documents(*rows), SMALL).collect()
    assert Counter(r["doc_id"] for r in left) == Counter([3, None, None, 8, 9])


def test_texts_under_one_id_are_told_apart(spark, documents, cluttered):
    import corpus_pipeline as P

    copied, near = "a text of some words that stands under two ids", " ".join(f"w{i}" for i in range(80))
    rows = [(1, copied), (2, copied), (2, "words of its own that no other document has"), (2, "and a third text that is linked with nothing"),
            (4, near), (4, near + " end"), (4, "something else"), (5, near), (6, "said twice"), (6, "Said  TWICE"), (7, None), (7, ""), (7, "text beside none"), (8, copied), (8, copied)]
    got = [P.near_duplicates(spark, cluttered(documents(*some)).select("source", "text", "value", "doc_id", "n_chars"), SMALL).collect() for some in (rows, rows[::-1])]
    assert Counter(got[0]) == Counter(got[1])
    left = Counter((r["doc_id"], r["text"]) for r in got[0])
    for choice in ([(4, near), (4, near + " end")], [(6, "said twice"), (6, "Said  TWICE")], [(7, None), (7, "")]):
        assert sum(left.pop(c, 0) for c in choice) == 1
    assert left == Counter([(1, copied), *rows[2:4], (4, "something else"), (7, "text beside none")])


def test_each_stage_calls_an_operator():
    import corpus_pipeline as P

    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None
    assert all(m for m in (mixing, neardup, packing, pii, quality))
