"""Sliding windows, splits and scaling.

Windows are cut from packed frames, one row per (channel, hour), never from pixel rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hourgrid.functions.columns import one_row


def pack_dense(grid: DataFrame, keys: Sequence[str], cell: Column, value: str = "value", out: str = "frame") -> DataFrame:
    """One row per frame with its values in cell order.  The frame must be complete: every cell has
    a row (value may be NULL); the array has as many entries as the grid has cells."""
    points = F.sort_array(F.collect_list(F.struct(cell.alias("c"), F.col(value).alias("v"))))
    return grid.groupBy(*keys).agg(points.alias("_p")).select(*keys, F.col("_p.v").alias(out))


def sliding_windows(frames: DataFrame, n_in: int, n_out: int, stride: int = 1, keys: Sequence[str] = ("channel",),
                    index: str = "ts_idx", frame: str = "frame", chunk: int = 256, drop_last: bool = False, check: bool = True) -> DataFrame:
    """X = frames i..i+n_in-1, Y = the next n_out; one row per sample.

    ``index`` counts 0..n-1 per key; over a gap no window is whole, so none crosses it.  The axis is cut into chunks; the first frames
    of a chunk are also sent to the chunk before, so each chunk completes its windows alone: the
    shuffle carries 1 + (n_in+n_out)/chunk copies of the data instead of n_in+n_out, and the work
    of one long series spreads over its chunks.  ``drop_last`` is S3's count, one window less.
    ``check`` makes a series that is too short an error; pass False where the length is known.
    """
    width = n_in + n_out
    halo = width if drop_last else width - 1
    chunk = max(chunk, halo, 1)
    home = F.floor(F.col(index) / chunk)
    to = F.when(F.col(index) % chunk < halo, F.array(home, home - 1)).otherwise(F.array(home))
    spread = frames.withColumn("_home", home).withColumn("_chunk", F.explode(to)).where(F.col("_chunk") >= 0)
    w = Window.partitionBy(*keys, "_chunk").orderBy(index)
    parts = [F.collect_list(frame).over(w.rowsBetween(0, n_in - 1)).alias("x_frames")]
    if n_out:
        parts.append(F.collect_list(frame).over(w.rowsBetween(n_in, width - 1)).alias("y_frames"))
    ahead = w.rowsBetween(0, halo)
    whole = (F.count(F.lit(1)).over(ahead) == halo + 1) & (F.max(index).over(ahead) - F.col(index) == halo)
    cut = spread.select(*keys, index, "_home", "_chunk", whole.alias("_whole"), *parts)
    keep = (F.col("_home") == F.col("_chunk")) & (F.col(index) % stride == 0) & F.col("_whole")
    if check:
        shortest = frames.groupBy(*keys).agg((F.max(index) + 1).alias("n")).agg(F.min("n").alias("n")).scalar()
        keep = F.assert_true(shortest >= width, F.lit("series shorter than one window and its target")).isNull() & keep
    return cut.where(keep).select(*keys, (F.col(index) / stride).cast("long").alias("sample_id"), *(["x_frames", "y_frames"] if n_out else ["x_frames"]))


def explode_frames(windows: DataFrame, column: str, keys: Sequence[str] = ("channel",), position: str = "frame_idx",
                   cell: str = "cell", value: str = "value") -> DataFrame:
    """Window rows back to (sample, frame, cell, value)."""
    frames = windows.select(*keys, "sample_id", F.posexplode(column).alias(position, "_f"))
    return frames.select(*keys, "sample_id", position, F.posexplode("_f").alias(cell, value))


def next_frame_labels(series: DataFrame, size: int, sensors: Sequence, index: str = "ts_idx", sensor: str = "sensor_id",
                      value: str = "value") -> DataFrame:
    """Y[i][s] = value of sensor s at i + size, one column per sensor."""
    at = (F.col(index) - size).alias("sample_id")
    return series.where(F.col(index) >= size).groupBy(at).agg(*[
        F.max(F.when(F.col(sensor) == s, F.col(value))).alias(f"s{s}") for s in sensors])


def temporal_split(df: DataFrame, index: str, n: int | Column, shares: Sequence[tuple[str, float]] = (("train", 0.70), ("valid", 0.15), ("test", 0.15)),
                   out: str = "split") -> DataFrame:
    """Consecutive shares of the axis, cut at int(n * cumulative share).

    S6 applies it to frames before windowing, S7/S8 to samples afterwards; another order of the
    names is S9.  The last name takes the rest.
    """
    if abs(sum(s for _, s in shares) - 1) > 1e-9:
        raise ValueError("split sizes must sum to 1")
    n = n if isinstance(n, Column) else F.lit(n)
    label, total = None, 0.0
    for name, share in shares[:-1]:
        total = round(total + share, 10)
        below = F.col(index) < (n * F.lit(total)).cast("long")
        label = (F.when if label is None else label.when)(below, name)
    return df.withColumn(out, label.otherwise(shares[-1][0]) if label is not None else F.lit(shares[-1][0]))


def rebase(df: DataFrame, index: str = "ts_idx", split: str = "split", keys: Sequence[str] = ()) -> DataFrame:
    """Index that starts at 0 inside each split, so that no window crosses a cut."""
    first = df.groupBy(*keys, split).agg(F.min(index).alias("_first"))
    return df.join(first, [*keys, split]).withColumn(index, F.col(index) - F.col("_first")).drop("_first")


def fit_scalers(df: DataFrame, keys: Sequence[str] = ("channel",), value: str = "value", split: str | None = "split") -> DataFrame:
    """S10/S11 state: mean and population deviation of the training rows; deviation 0 becomes 1."""
    rows = df.where(F.col(split) == "train") if split else df
    sd = F.stddev_pop(value)
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias("std"))


def apply_scalers(df: DataFrame, scalers: DataFrame, keys: Sequence[str] = ("channel",), value: str = "value",
                  reuse: Mapping[str, str] | None = None) -> DataFrame:
    """(v - mean) / std; ``reuse`` maps a forecast channel to the channel whose state it takes.
    Channels without a state pass through unscaled."""
    if reuse:
        pairs = F.create_map(*[F.lit(v) for kv in reuse.items() for v in kv])
        base = F.coalesce(F.try_element_at(pairs, F.col("channel")), F.col("channel"))
        df = df.withColumn("_base", base)
        out = df.join(scalers.withColumnRenamed("channel", "_base"), "_base", "left").drop("_base")
    elif keys:
        out = df.join(scalers, list(keys), "left")
    else:
        out = df.withColumn("_s", one_row(scalers)).select("*", "_s.*").drop("_s")
    scaled = (F.col(value) - F.col("mean")) / F.col("std")
    return out.withColumn(value, F.when(F.col("mean").isNotNull(), scaled).otherwise(F.col(value))).drop("mean", "std")


def min_max(df: DataFrame, value: str = "value", eps: float = 1e-8) -> DataFrame:
    """S12, elevation: (v - min) / (max - min + eps)."""
    b = one_row(df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")))
    return df.withColumn("_b", b).withColumn(value, (F.col(value) - F.col("_b.lo")) / (F.col("_b.hi") - F.col("_b.lo") + eps)).drop("_b")


def vegetation_layer(grid: DataFrame, ts: str = "ts", value: str = "value", eps: float = 1e-8) -> DataFrame:
    """S12, vegetation: the first frame only; (v + 1) / 2 when it lies in [-1, 1], else min-max."""
    first = grid.where(F.col(ts) == grid.agg(F.min(ts).alias("t")).scalar())
    b = one_row(first.agg(F.min(value).alias("lo"), F.max(value).alias("hi")))
    unit = (F.col("_b.lo") >= -1) & (F.col("_b.hi") <= 1)
    scaled = F.when(unit, (F.col(value) + 1) / 2).otherwise((F.col(value) - F.col("_b.lo")) / (F.col("_b.hi") - F.col("_b.lo") + eps))
    return first.withColumn("_b", b).withColumn(value, scaled).drop("_b")


def apply_manifest(grid: DataFrame, manifest: DataFrame, scalers: DataFrame, value: str = "value") -> DataFrame:
    """The channel table decides membership, display name and scaling in one plan.

    ``manifest``: (channel, name, scale, temporal, forecast).
    """
    rows = grid.join(manifest, "channel").join(scalers, "channel", "left")
    scaled = (F.col(value) - F.col("mean")) / F.col("std")
    return rows.withColumn(value, F.when(F.col("scale") & F.col("mean").isNotNull(), scaled).otherwise(F.col(value))).drop("mean", "std")


def event_samples(samples: DataFrame, first_hour: Column, last_hour: Column, n_in: int, n_train: Column | int,
                  sample: str = "sample_id") -> DataFrame:
    """Samples whose windows touch the event: [first - n_in, last - n_in + 1] clipped to the set."""
    lo = F.greatest(F.lit(0), first_hour - n_in)
    hi = F.least((n_train if isinstance(n_train, Column) else F.lit(n_train)) - 1, last_hour - n_in + 1)
    return samples.where((F.col(sample) >= lo) & (F.col(sample) <= hi))


def batch_index(df: DataFrame, size: int, order: str = "sample_id", drop_remainder: bool = False) -> DataFrame:
    """Batch number of position ``order`` (0-based); the short last batch can be dropped."""
    out = df.withColumn("batch", F.floor(F.col(order) / size))
    if drop_remainder:
        n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
        out = out.where(F.col("batch") < F.floor(n / size))
    return out


def window_mismatches(windows: DataFrame, n_in: int, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """Samples for which X of sample i + n_in differs from Y of sample i (none when sound)."""
    y = windows.select(*keys, (F.col("sample_id") + n_in).alias("sample_id"), "y_frames")
    return windows.select(*keys, "sample_id", "x_frames").join(y, [*keys, "sample_id"]).where(F.col("x_frames") != F.col("y_frames"))


def shifted_pairs(windows: DataFrame, n: int, frames: str = "x_frames") -> DataFrame:
    """Inside one window, inputs 0..n-2 and targets 1..n-1."""
    return windows.withColumn("x_pair", F.slice(frames, 1, n - 1)).withColumn("y_pair", F.slice(frames, 2, n - 1))


def shuffle_key(key: str | Column, seed: int) -> Column:
    """Seeded, repeatable, engine-independent order key."""
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", F.lit(str(seed)), c.cast("string")))


def shuffled_order(samples: DataFrame, seed: int, sample: str = "sample_id", digits: int = 3) -> DataFrame:
    """Position of each sample in a seeded shuffle.  Runs on the sample ids alone.

    The keys are uniform hexadecimal digits: ids are ranked inside each of 16**``digits`` key ranges,
    in parallel, and start from the number of ids in the ranges before.
    """
    keyed = samples.select(sample).distinct().withColumn("_key", shuffle_key(sample, seed))
    keyed = keyed.withColumn("_range", F.substring("_key", 1, digits))
    sizes = keyed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))     # one row a key range
    base = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_key", sample)) - 1
    return keyed.join(base, "_range").withColumn("position", (F.col("_base") + place).cast("int")).select(sample, "position")
