"""Exact quantiles that do not gather a group in one place."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hourgrid.functions.columns import one_row
from hourgrid.session import shared_dir

#: Entries of the sketch; its ranks are off by the group's rows over this at most.
ACCURACY = 10_000
#: Share of a group on either side of a wanted rank that is ranked exactly: five times the sketch's error.
MARGIN = 5 / ACCURACY


def stored(df: DataFrame, name: str = "groups") -> DataFrame:
    """``df``, a table with a row per group, written to the shared folder at once.

    A join then knows how small it is.  What is planned for an aggregate is the size of its input, and what adaptive
    execution sees is its shuffle, so that all rows would be sorted by their few keys, a hot key in one task.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], extra: Sequence[Column] = ()) -> DataFrame:
    """Linear-interpolated quantiles per key, and the aggregates ``extra`` of the same pass.

    The built-in exact percentile keeps every distinct value of a group in one aggregation buffer.  Here a distributed
    selection takes two passes over ``df``, both aggregates with map-side combine.  A bounded sketch gives each group an
    interval of values around every wanted rank; then rows are counted between the intervals, and by value inside
    them.  The sketches, a row per group, are written first, so that the rows need no shuffle to meet them unless the
    groups themselves are too many to send around.  So a group of any size comes down to a thousandth of its distinct values per quantile before anything
    is ordered.  A rank just outside its interval is the least or greatest of the rows there; one further off, which
    the sketch rules out, ends the job.

    Groups without values have no row unless ``extra`` asks for one; its quantiles are NULL.
    """
    keys = list(keys)
    at = [q for p in probs.values() for q in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    sketch = df.groupBy(*keys).agg(F.percentile_approx(value, at, ACCURACY).alias("_at"), *extra)
    if keys:
        sketch = stored(sketch, "sketch")
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    rows = rows.join(sketch.select(*keys, "_at"), keys) if keys else rows.withColumn("_at", sketch.select("_at").scalar())
    bounds = [(F.get("_at", F.lit(2 * i)), F.get("_at", F.lit(2 * i + 1))) for i in range(len(probs))]
    segment, inside = F.lit(0), F.lit(False)
    for low, high in bounds:
        segment = segment + (F.col("_v") >= low).cast("int") + (F.col("_v") > high).cast("int")
        inside = inside | F.col("_v").between(low, high)
    parts = rows.groupBy(*keys, segment.alias("_s"), F.when(inside, F.col("_v")).alias("_in")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))

    group = Window.partitionBy(*keys)
    ranked = parts.withColumn("_hi", F.sum("_c").over(group.orderBy("_s", "_in").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_total", F.sum("_c").over(group))
    low, high = F.col("_hi") - F.col("_c"), F.col("_hi")
    lost = F.raise_error(F.lit("a rank lies outside the interval of its sketch"))
    picks = []
    for name, p in probs.items():
        rank = (F.col("_total") - 1) * F.lit(float(p))
        for tag, k in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            held = F.when(F.col("_in").isNotNull(), F.col("_in")).when(k == low, F.col("_least")).when(k == high - 1, F.col("_most")).otherwise(lost)
            picks.append(F.max(F.when((low <= k) & (k < high), held)).alias(f"_{name}_{tag}"))
        picks.append(F.max(rank - F.floor(rank)).alias(f"_{name}_f"))
    out = ranked.groupBy(*keys).agg(*picks)
    out = out.select(*keys, *[(F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")).alias(n) for n in probs])
    if not extra:
        return out
    if keys:
        return sketch.drop("_at").join(out, keys, "left")
    return sketch.drop("_at").withColumn("_q", one_row(out)).select("*", "_q.*").drop("_q")
