"""Global row numbers without gaps, in the order of given columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from hourgrid.llm.scratch import Scratch

#: Row numbers of equal rows are unrolled in arrays of this length at most.
RUN = 65_536


def number_rows(scratch: Scratch, df: DataFrame, columns: Sequence[str], name: str = "numbered") -> DataFrame:
    """``columns`` and ``row_number`` (0, 1, ... in the order of ``columns``, nulls first) for every row of df.

    Rows equal in all columns are interchangeable, so they are counted with map-side combine and unrolled
    only after the numbers are known: a row repeated a billion times is one row in every shuffle.  The
    distinct rows are range-partitioned and written once with their partition's number; the only table
    without a key is the one with a row per partition.
    """
    columns = list(columns)
    counted = df.groupBy(*columns).agg(F.count("*").alias("__n"))
    keys = scratch.save(counted.repartitionByRange(*columns).withColumn("__part", F.spark_partition_id()), name)
    per_part = keys.groupBy("__part").agg(F.sum("__n").alias("__rows"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    base = per_part.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__base"))
    inside = W.partitionBy("__part").orderBy(*columns).rowsBetween(W.unboundedPreceding, -1)
    first = F.col("__base") + F.coalesce(F.sum("__n").over(inside), F.lit(0))
    placed = keys.join(F.broadcast(base), "__part").withColumn("__first", first)  # one row a partition
    runs = placed.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__n - 1) div {RUN}"))))
    low, high = F.col("__first") + RUN * F.col("__run"), F.col("__first") + F.least(F.col("__n"), RUN * (F.col("__run") + 1)) - 1
    return runs.select(*columns, F.explode(F.sequence(low, high)).alias("row_number"))
