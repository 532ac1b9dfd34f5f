"""The training set that its channel table decides, against plain loops."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest

from hourgrid.functions.columns import CYCLE_MAX
from hourgrid.plans import learning

START = datetime(2024, 3, 1)
SCHEMA = "position int, channel string, name string, scale boolean, forecast boolean"
TABLE = [(0, "a", "A", True, False), (1, "b", "B", True, None), (2, "b", "B_Forecast", True, True), (3, "climatology", "Clim", None, False),
         (4, "height", "Height", False, False), (5, "hour_sin", "Hour", False, True), (6, "nowhere", "Nowhere", True, False)]
LENGTHS = {"a": 130, "b": 100, "unused": 40}


def _grid(spark, lengths):
    rnd = random.Random(1)
    value = {(c, i, k): rnd.uniform(-3, 9) for c, n in lengths.items() for i in range(-3, n) for k in range(6)}
    rows = [(c, START + timedelta(hours=i), k // 3, k % 3, v, "extra") for (c, i, k), v in value.items()]
    return value, spark.createDataFrame(rows, "channel string, ts timestamp_ntz, x int, y int, value double, name string").repartition(5)


def test_channel_table_decides_everything(spark):
    value, grid = _grid(spark, LENGTHS)
    height = spark.createDataFrame([(k // 3, k % 3, k / 5) for k in range(6)], "x int, y int, value double")
    out = learning.manifest_training_set(grid, spark.createDataFrame(TABLE, SCHEMA), "a", "2024-03-01", (2, 3), 4, 2, 3, static={"height": height})
    inputs, targets, scalers = out
    bounds = {"train": (0, 70), "valid": (70, 85), "test": (85, 100)}          # 100 hours: the shortest of a and b; "unused" is in no row

    def plain(channel, i):
        if channel == "climatology":
            past = [j for j in range(i - 24, -1, -24)]
            return [sum(value["a", j, k] for j in past) / len(past) if past else value["a", i, k] for k in range(6)]
        if channel == "height":
            return [k / 5 for k in range(6)]
        if channel == "hour_sin":
            return [math.sin((START + timedelta(hours=i)).hour * 2 * math.pi / CYCLE_MAX["hour"])] * 6
        return [value[channel, i, k] for k in range(6)]

    state = {r.channel: (r.mean, r.std) for r in scalers.collect()}
    assert set(state) == {"a", "b"}
    for c, (mean, std) in state.items():
        flat = [v for i in range(70) for v in plain(c, i)]
        m = sum(flat) / len(flat)
        assert (mean, std) == pytest.approx((m, math.sqrt(sum((v - m) ** 2 for v in flat) / len(flat))))
    samples = {(s, j): lo + 3 * j for s, (lo, hi) in bounds.items() for j in range((hi - lo - 6) // 3 + 1)}
    got = {(r.split, r.name, r.sample_id): r for r in inputs.collect()}
    assert set(got) == {(s, row[2], j) for s, j in samples for row in TABLE[:6]}
    for position, channel, name, scale, forecast in TABLE[:6]:
        mean, std = state[channel] if scale else (0.0, 1.0)
        for (s, j), lo in samples.items():
            r, first, n = got[s, name, j], lo + (4 if forecast else 0), 2 if forecast else 4
            assert r.position == position and len(r.frames) == n
            for d, frame in enumerate(r.frames):
                assert frame == pytest.approx([(v - mean) / std for v in plain(channel, first + d)])
    seen = {(r.split, r.sample_id): r.y_frames for r in targets.collect()}
    assert set(seen) == set(samples)
    for key, lo in samples.items():
        assert seen[key] == [plain("a", lo + 4), plain("a", lo + 5)]


def test_short_split_is_an_error(spark):
    _, grid = _grid(spark, {"a": 30})
    inputs, targets, _ = learning.manifest_training_set(grid, spark.createDataFrame(TABLE, SCHEMA), "a", "2024-03-01", (2, 3), 4, 2)
    for df in (inputs, targets):
        with pytest.raises(Exception, match="shorter than one window"):
            df.collect()
