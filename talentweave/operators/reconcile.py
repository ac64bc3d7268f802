"""What differs between two tables, found by trees of hashes.

Rows are dealt to leaves by a hash of their key; a leaf has the number of its rows and the sums of their hashes, and a node
has those of its children added up. Trees are small and can be kept with a release. Two trees are compared from the root:
only children of nodes that differ are looked at, and only rows of leaves that differ are read again and compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

#: Levels below the root, and binary digits of a step between levels: 65,536 leaves.
LEVELS = 4
STEP = 4


def _leaf(keys: list[str], levels: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*(F.col(k).cast("string") for k in keys), *(F.col(k).isNull() for k in keys)), 64 - STEP * levels)


def tree(df: DataFrame, keys: list[str], levels: int = LEVELS) -> DataFrame:
    """(level, node, n, h0, h1): rows and sums of their hashes for every node that has rows; level 0 is the root.

    Rows are hashed once, column by column as text with nulls told apart; the levels above come from the leaves.
    """
    shown = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    digest = F.sha2(shown, 256)
    number = lambda at: F.conv(digest.substr(at, 15), 16, 10).cast("decimal(38,0)")
    rows = df.select(_leaf(keys, levels).alias("node"), number(1).alias("h0"), number(16).alias("h1"))
    leaves = cut(rows.groupBy("node").agg(F.count("*").alias("n"), F.sum("h0").alias("h0"), F.sum("h1").alias("h1")).withColumn("level", F.lit(levels)))
    # all levels from the leaves at once: 65,536 rows at most
    every = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    above = every.withColumn("node", reduce(lambda x, k: F.when(F.col("level") == k, F.shiftrightunsigned("node", STEP * (levels - k))).otherwise(x), range(levels), F.col("node")))
    return above.groupBy("level", "node").agg(F.sum("n").alias("n"), F.sum("h0").alias("h0"), F.sum("h1").alias("h1"))


def differing_leaves(a: DataFrame, b: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(node) of the leaves in which two trees differ. A level is looked at below differing nodes of the one above only."""
    a, b = cut(a), cut(b)
    open_ = None
    for level in range(levels + 1):
        sides = [x.where(F.col("level") == level).select("node", F.struct("n", "h0", "h1").alias(name)) for x, name in ((a, "a"), (b, "b"))]
        if open_ is not None:
            below = open_.select(F.col("node").alias("parent"))
            sides = [x.withColumn("parent", F.shiftrightunsigned("node", STEP)).join(below, "parent", "left_semi").drop("parent") for x in sides]
        open_ = cut(sides[0].join(sides[1], "node", "full").where("not (a <=> b)").select("node"))
        if not open_.head(1):
            break
    return open_


def differences(a: DataFrame, b: DataFrame, keys: list[str], trees: tuple[DataFrame, DataFrame] | None = None, levels: int = LEVELS) -> DataFrame:
    """The columns, `old_rows` and `new_rows`: every distinct row that isn't as often in `b` as in `a`.

    `trees` are those of `tree` with the same keys, kept from before or made now. Both tables have the same columns; nulls
    are equal to each other. Equal tables, and two empty ones, give no rows and are not read beyond their trees.
    """
    if set(a.columns) != set(b.columns):
        raise ValueError(f"other columns: {sorted(set(a.columns) ^ set(b.columns))}")
    leaves = differing_leaves(*(trees or (tree(a, keys, levels), tree(b, keys, levels))), levels)
    side = lambda df, old, new: df.withColumn("_node", _leaf(keys, levels)).join(F.broadcast(leaves.withColumnRenamed("node", "_node")), "_node", "left_semi").select(*a.columns, F.lit(old).alias("_old"), F.lit(new).alias("_new"))
    both = side(a, 1, 0).unionByName(side(b, 0, 1))
    counts = both.groupBy(*a.columns).agg(F.sum("_old").alias("old_rows"), F.sum("_new").alias("new_rows"))
    return counts.where("old_rows <> new_rows")


def changes(a: DataFrame, b: DataFrame, keys: list[str], trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(keys, change): keys that were added, removed or whose rows are others."""
    found = differences(a, b, keys, trees)
    hit = found.groupBy(*keys).agg(F.sum("old_rows").alias("old"), F.sum("new_rows").alias("new"))
    return hit.select(*keys, F.when(F.col("old") == 0, "added").when(F.col("new") == 0, "removed").otherwise("changed").alias("change"))
