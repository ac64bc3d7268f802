"""Neighbours in a global order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: The key of rows without an id: before all others.
NO_ID = -(1 << 63)


def order_key(column: Column) -> Column:
    return F.coalesce(column.cast("long"), F.lit(NO_ID))


def hash63(column: Column) -> Column:
    """A number from 0 to below 2 ** 63 that depends on the value alone."""
    return F.shiftrightunsigned(F.xxhash64(column.cast("string")), 1)


def in_share(column: Column, share: float) -> Column:
    """Whether a value is in a sample of about this share; any share above 2 ** -63 has members."""
    if share >= 1:
        return F.lit(True)
    return hash63(column) <= F.lit(int(share * (1 << 63)) - 1)


def successors(keys: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(key, next_key) for distinct keys: the next larger key, and after the largest the smallest.

    Keys are cut into ranges; a window runs within each range, and a second one over one row for each range joins them.
    """
    ranged = scratch.save(keys.select("key").repartitionByRange("key").withColumn("range", F.spark_partition_id()), f"{name}_ranges")
    firsts = ranged.groupBy("range").agg(F.min("key").alias("first"))
    by_range = Window.orderBy("range")
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(by_range), F.min("first").over(Window.partitionBy(F.lit(1)))).alias("after"))
    linked = ranged.join(firsts, "range").withColumn("lead", F.lead("key").over(Window.partitionBy("range").orderBy("key")))
    chain = scratch.save(linked.select("key", F.coalesce("lead", "after").alias("next_key")), name)
    scratch.drop(f"{name}_ranges")
    return chain
