from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa

from hourgrid.llm import boost, rules, textscan as S

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i: i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if seen[tuple(w[i: i + 8])] > 1 for j in range(i, i + 8)}
    counts = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)
    return (*counts, counts[0] < 20 or 100 * counts[4] > 30 * counts[0])


def test_counts_equal_brute_force(documents, cluttered, odd):
    rows = odd + [(20, "a b\na b\n\na b\r\nc|d #$"), (21, " ".join(str(i % 13) for i in range(60))), (22, " ".join(str(i) for i in range(40)) + "\n" + " ".join(str(i) for i in range(9)))]
    trees = boost.fit(np.zeros((0, len(rules.FEATURES))), np.zeros(0), rules.MONOTONE)
    out = rules.judge(cluttered(documents(*rows)), trees).collect()
    got = Counter((r["doc_id"], *(r[c] for c in rules.COUNTS), r["base_failed"]) for r in out)
    assert got == Counter((i, *brute(t)) for i, t in rows)
    assert all(r["kept"] is False for r in out if r["base_failed"])
    assert rules.judge(documents((1, "x")).limit(0), trees).collect() == []


def test_trees_learn_and_keep_their_direction():
    rng = np.random.default_rng(0)
    x = rng.random((1500, 3))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5) | (rng.random(1500) < 0.05)).astype(float)
    monotone = np.array([0, 0, -1])
    model = boost.fit(x, y, monotone)
    fresh = rng.random((800, 3))
    right = (model.probability(fresh) > 0.5) == ((fresh[:, 0] > 0.6) ^ (fresh[:, 1] > 0.5))
    assert right.mean() > 0.93
    slope = rng.random((400, 1)) < 0.5
    x2 = np.concatenate([x, rng.random((1500, 1))], 1)
    y2 = (x2[:, 3] + 0.3 * rng.standard_normal(1500) < 0.5).astype(float)
    falling = boost.fit(x2, y2, np.array([0, 0, 0, -1]))
    grid = np.repeat(rng.random((50, 4)), 40, 0)
    grid[:, 3] = np.tile(np.linspace(0, 1, 40), 50)
    p = falling.probability(grid).reshape(50, 40)
    assert (np.diff(p, axis=1) <= 1e-12).all() and slope.size
    rising = boost.fit(x2, y2, np.array([0, 0, 0, 1])).probability(grid).reshape(50, 40)
    assert (np.diff(rising, axis=1) >= -1e-12).all()


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(2)
    x = rng.random((300, 4))
    model = boost.fit(x, (x[:, 0] > x[:, 1]).astype(float), np.zeros(4), trees=7, depth=3)
    for row, margin in zip(x[:40], model.margin(x[:40])):
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += v[node - len(f)]
        assert abs(total - margin) < 1e-9


def test_held_out_accuracy(spark):
    from hourgrid.llm.queries import QUERIES
    from tests.conftest import SMALL
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    out = QUERIES["op3_quality_rules"](spark, SMALL.replace("0.001", "0.01")).where("crc32(cast(doc_id as string)) % 5 = 0")
    labels = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/labels.parquet")
    rows = out.join(labels, "doc_id").where("NOT base_failed").select("kept", "quality").collect()
    assert np.mean([r["kept"] == bool(r["quality"]) for r in rows]) > 0.9


def test_regular_lines_do_not_count_as_repeated():
    lines = ["".join("ab"[(bin(i).count("1") & 1) ^ k] for i in range(4096)) for k in (0, 1)]
    text = "\n".join([*lines, lines[0]])
    counts = rules.statistics(next(S.slices(pa.array([text])))[1])[0]
    assert counts["n_dup_lines"].tolist() == [1]
