from __future__ import annotations

import numpy as np
import pyarrow as pa

from hourgrid.llm import quality, queries, textscan as S
from tests.conftest import SMALL


def test_ratios_and_dual_descent():
    rng = np.random.default_rng(0)
    docs = [np.unique(rng.integers(0, 50, 10) + (100 if y else 0) * (rng.random() < 0.9)) for y in (np.arange(300) % 3 > 0)]
    y = (np.arange(300) % 3 > 0).astype(float)
    ratio = quality.log_count_ratio(docs, y)
    assert ratio[100:150].mean() > 0.5 > ratio[:50].mean()
    weight, bias = quality.dual_descent(docs, y, ratio, rounds=40)

    def loss(w, b):
        x = np.zeros((len(docs), quality.BUCKETS), np.float32)
        for i, d in enumerate(docs):
            x[i, d] = ratio[d] / np.sqrt(np.square(ratio[d]).sum())
        cost = len(y) / (2 * np.where(y > 0, y.sum(), len(y) - y.sum()))
        return 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - np.where(y > 0, 1, -1) * (x @ w + b))).sum()

    best = loss(weight, bias)
    for _ in range(10):
        step = np.zeros(quality.BUCKETS)
        step[:150] = rng.normal(size=150) * 0.05
        assert loss(weight + step, bias + rng.normal() * 0.05) > best


def test_indicators_are_distinct_and_by_row():
    texts = ["a b a b a b", None, "", "Zz 12 *** a"]
    (_, scan), = S.slices(pa.array(texts, pa.string()))
    row, bucket = quality.indicators(scan)
    assert len(set(zip(row, bucket))) == len(row) and set(row) == {0, 3}
    (_, alone), = S.slices(pa.array(texts[3:], pa.string()))
    assert sorted(bucket[row == 3]) == sorted(quality.indicators(alone)[1])


def test_held_out_accuracy(spark):
    sf = SMALL.replace("0.001", "0.01")
    out = queries.QUERIES["op9_quality_classifier"](spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    score, label = np.array([r["score"] for r in rows]), np.array([r["quality"] for r in rows])
    assert (score[label == 1][:, None] > score[label == 0]).mean() > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_labels_of_the_held_out_fifth_do_not_matter(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    assert queries.training_labels(labels).where("crc32(cast(doc_id as string)) % 5 = 0").count() == 0


def test_odd_rows(documents, cluttered, odd, spark):
    labels = spark.createDataFrame([(1, 0), (4, 1), (None, 1), (77, 0)], "doc_id long, quality int")
    df = cluttered(documents(*odd))
    model = quality.fit_quality(df, labels)
    out = quality.classify(df, model).collect()
    assert len(out) == len(odd) and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] == 5}) == 1
    assert quality.classify(df.limit(0), model).collect() == []
    assert quality.fit_quality(df.limit(0), labels.limit(0)).score(np.zeros(0, int), np.zeros(0, int), 2).tolist() == [0.5, 0.5]
