"""Sums over a moving frame, at a cost per row that does not depend on the width of the frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Frames of at most so many positions are summed directly: below that the sorts cost more than the additions (measured).
SHORT = 96


def frame_sums(df: DataFrame, keys: Sequence[str], position: str, first: int, last: int, values: Mapping[str, Column]) -> DataFrame:
    """Adds, for every name of ``values``, a struct (n, total): count and sum of the values that are not NULL over the
    rows of the same key whose ``position`` lies in [position + first, position + last].

    The axis of a key is cut into blocks as long as the frame.  A frame then is the end of one block and the start of
    the next: a sum from the back of the one and a sum from the front of the other.  Nothing is subtracted,
    so values outside the frame leave no rounding error, and a NaN or infinity reaches only frames that hold it.

    ``position`` is a whole number and may have gaps and repeats; repeats count together.  An empty frame and a NULL
    position give (0, NULL).
    """
    if last < first:
        raise ValueError("the frame ends before it starts")
    width, pos = last - first + 1, F.col(position)
    held = df.select("*", *[v.alias(f"_v_{name}") for name, v in values.items()])
    sums = lambda w: F.struct(*[F.struct(F.count(f"_v_{name}").over(w).alias("n"), F.sum(f"_v_{name}").over(w).alias("total")).alias(name) for name in values])
    drop = [f"_v_{name}" for name in values]
    by_key = Window.partitionBy(*keys)
    if width <= SHORT:
        out = held.withColumn("_sums", sums(by_key.orderBy(position).rangeBetween(first, last)))
        parts = {name: F.when(pos.isNotNull(), F.col(f"_sums.{name}")) for name in values}
        return _finish(df, out, parts, [*drop, "_sums"])
    start = lambda p: p - F.pmod(p, F.lit(width))
    block = Window.partitionBy(*keys, "_block")
    held = (held.withColumn("_block", start(pos))
                .withColumn("_front", sums(block.orderBy(position).rangeBetween(Window.unboundedPreceding, 0)))
                .withColumn("_back", sums(block.orderBy(F.desc(position)).rangeBetween(Window.unboundedPreceding, 0))))
    # The last row not after the end of the frame, and the first row not before its start: a frame that ends or
    # starts at the row itself needs no search.
    head, tail = F.struct("_block", "_front"), F.struct("_block", "_back")
    if last:
        head = F.last(head).over(by_key.orderBy(position).rangeBetween(Window.unboundedPreceding, last))
    if first:
        tail = F.last(tail).over(by_key.orderBy(F.desc(position)).rangeBetween(Window.unboundedPreceding, -first))
    out = held.withColumn("_head", head).withColumn("_tail", tail)
    has_head = F.col("_head._block") == start(pos + last)
    has_tail = (F.col("_tail._block") == start(pos + first)) & (F.pmod(pos + first, F.lit(width)) != 0)
    parts = {}
    for name in values:
        a, b = F.when(has_tail, F.col(f"_tail._back.{name}")), F.when(has_head, F.col(f"_head._front.{name}"))
        n = F.coalesce(a["n"], F.lit(0)) + F.coalesce(b["n"], F.lit(0))
        parts[name] = F.struct(n.alias("n"), F.coalesce(a["total"] + b["total"], a["total"], b["total"]).alias("total"))
    return _finish(df, out, parts, [*drop, "_block", "_front", "_back", "_head", "_tail"])


def _finish(df: DataFrame, out: DataFrame, parts: Mapping[str, Column], drop: Sequence[str]) -> DataFrame:
    for name, part in parts.items():
        out = out.withColumn(name, F.struct(F.coalesce(part["n"], F.lit(0)).alias("n"), part["total"].alias("total")))
    return out.drop(*drop)
