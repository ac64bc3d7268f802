"""Cutting lineage through the folder that driver and executors share, and numbering rows without one task for all of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`. Where none is set, a local session (tests) gets a temporary folder; on a cluster that is an
    error, as executors don't share the driver's folders."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read again: what follows knows nothing of the plan behind it. (After
    `checkpoint()` a plan keeps the constraints of the one before, which double with each join of a loop.)"""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def consecutive(df: DataFrame, *order: Column | str, name: str = "id", after: int = 0) -> DataFrame:
    """Numbers rows after + 1, after + 2 .. in the given order, which must be total.

    Rows are dealt to ranges of the order; a range is numbered on its own and starts behind the rows of those before it,
    of which only the counts reach the driver.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before, total = [], after
    for r in sorted(ranged.groupBy("_range").count().collect()):
        before += [F.lit(r[0]), F.lit(total).cast("long")]
        total += r[1]
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    shift = F.create_map(*before)[F.col("_range")] if before else F.lit(after).cast("long")
    return ranged.withColumn(name, place + shift).drop("_range")


def neighbours_in_order(keys: DataFrame, points: DataFrame) -> DataFrame:
    """(group, point, before, at, after) for distinct (group, point): the largest key of the group below the point, whether
    the point is a key, and the smallest key above it.

    Both are dealt to ranges of (group, key). Within a range the neighbours come from two windows; those that lie in other
    ranges from a table of the least and largest key of each group in each range.
    """
    rows = keys.select("group", "key", F.lit(True).alias("is_key"), F.lit(False).alias("is_point"))
    rows = rows.unionByName(points.select("group", F.col("point").alias("key"), F.lit(False).alias("is_key"), F.lit(True).alias("is_point")))
    rows = rows.groupBy("group", "key").agg(F.max("is_key").alias("is_key"), F.max("is_point").alias("is_point"))
    ranged = cut(rows.repartitionByRange("group", "key").withColumn("range", F.spark_partition_id()))
    own = F.when(F.col("is_key"), F.col("key"))
    ends = ranged.groupBy("group", "range").agg(F.min(own).alias("least"), F.max(own).alias("largest"))
    earlier = Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    later = Window.partitionBy("group").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("group", "range", F.max("largest").over(earlier).alias("largest"), F.min("least").over(later).alias("least"))
    here = Window.partitionBy("range", "group")
    down, up = here.orderBy("key").rowsBetween(Window.unboundedPreceding, -1), here.orderBy(F.desc("key")).rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.withColumns({"before": F.last(own, True).over(down), "after": F.last(own, True).over(up)}).where("is_point").join(ends, ["group", "range"])
    return found.select("group", F.col("key").alias("point"), F.coalesce("before", "largest").alias("before"), F.col("is_key").alias("at"), F.coalesce("after", "least").alias("after"))
