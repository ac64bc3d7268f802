"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session. Where none is set, a local session (tests) gets a temporary folder; on a cluster
    that is an error, as executors don't share the driver's folders."""
    context = spark.sparkContext
    known = context.getConf().get("spark.checkpoint.dir", None)
    if not known:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        known = "file://" + tempfile.mkdtemp(prefix="shared-")
        context.setCheckpointDir(known)
    return known


class Scratch:
    """Writes DataFrames as Parquet tables in the shared folder, which cuts lineage and survives lost executors.

    Tables that later jobs no longer read can be dropped, so a query holds only what it still needs.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        path = f"{self.root}/{table}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of finished steps now, not when the driver next collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
