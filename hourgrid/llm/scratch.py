"""Intermediate tables in the shared folder of the cluster.

A table written here cuts the lineage: a lost executor costs a reread, not a recomputation of every
step before.  The folder is ``spark.checkpoint.dir`` where the cluster names one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hourgrid.session import shared_dir


#: Bytes of an Arrow batch between the JVM and a Python worker.  Texts and vectors are long rows; smaller batches
#: cost little per row and keep both sides of every running task small.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> SparkSession:
    """Hold the session's Arrow batches to BATCH_BYTES, unless the session already asks for less."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return spark


class Scratch:
    """Tables of one operator call.  ``drop`` removes those that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
