"""Average linkage over cosine distance by reciprocal nearest neighbours.

The mean distance between two clusters is 1 minus the product of their mean unit vectors, so a cluster is its sum of unit
vectors and its size, and no matrix of distances is kept. Average linkage is reducible: a merge never comes nearer to a third
cluster than its parts were. So all pairs that are each other's nearest merge in the same round, whatever their distance, and
the tree is the one that merging the nearest pair of all, one by one, would give. For the same reason a cluster's nearest one
stays until that is merged itself; only the others look again. Rounds end when the clusters left fit one task, which
follows chains of nearest neighbours to the end. Where distances are equal, the tree is one of those possible.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..lineage import cut

#: Clusters of either side that one task multiplies.
BLOCK_ROWS = 4_000
_CHUNK = 500
_DIGITS = 12


def _means(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids, ascending, and mean unit vectors."""
    table = table.sort_by("id")
    sums = np.array(table.column("sums").to_pylist(), float).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0))
    return table.column("id").to_numpy(), sums / table.column("size").to_numpy()[:, None]


def _nearest(asked: pa.Table, given: pa.Table) -> pa.Table:
    (ids, a), (others, b) = _means(asked), _means(given.rename_columns([c.removeprefix("b_") for c in given.column_names]))
    other, product = np.zeros(len(ids), np.int64), np.full(len(ids), -np.inf)
    for first in range(0, len(ids), _CHUNK) if len(others) and len(ids) else ():
        part = slice(first, first + _CHUNK)
        score = np.round(a[part] @ b.T, _DIGITS)
        score[ids[part, None] == others] = -np.inf
        at = score.argmax(axis=1)  # the smallest id on ties
        other[part], product[part] = others[at], score[np.arange(len(at)), at]
    there = product > -np.inf
    return pa.table({"id": ids[there], "other": other[there], "product": product[there]})


def nearest(asked: DataFrame, clusters: DataFrame, n_asked: int, n: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, other, product): the nearest other cluster of each, the smaller id on ties. Blocks of both sides meet in a
    task, and one row for each cluster leaves it."""
    i = max(1, -(-n_asked // block_rows))
    j = max(1, -(-n // block_rows), -(-clusters.sparkSession.sparkContext.defaultParallelism // i))
    block = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = asked.select(block(i).alias("i"), "id", "size", "sums").withColumn("j", every(j))
    # other names on the other side: the optimiser takes columns of one origin for each other and drops them
    right = clusters.select(block(j).alias("b_j"), F.col("id").alias("b_id"), F.col("size").alias("b_size"), F.col("sums").alias("b_sums")).withColumn("b_i", every(i))
    found = left.groupBy("i", "j").cogroup(right.groupBy("b_i", "b_j")).applyInArrow(_nearest, "id long, other long, product double")
    return found.groupBy("id").agg(F.max_by(F.struct("other", "product"), F.struct("product", -F.col("other"))).alias("x")).select("id", "x.*")


def chain_merges(ids: np.ndarray, sums: np.ndarray, sizes: np.ndarray, next_id: int) -> list[tuple[int, int, int, float]]:
    """(id, a, b, height) of all merges of a few clusters, by chains of nearest neighbours; new ids count from `next_id`."""
    ids, sums, sizes = ids.tolist(), sums.copy(), sizes.astype(float).copy()
    alive = np.ones(len(ids), bool)
    chain: list[int] = []
    out = []
    for _ in range(len(ids) - 1):
        while True:
            if not chain:
                chain.append(int(np.flatnonzero(alive)[0]))
            top = chain[-1]
            product = np.where(alive, (sums @ sums[top]) / (sizes * sizes[top]), -np.inf)
            product[top] = -np.inf
            to = int(product.argmax())
            if len(chain) > 1 and product[to] <= product[chain[-2]]:
                break
            chain.append(to)
        b, a = chain.pop(), chain.pop()
        out.append((next_id, min(ids[a], ids[b]), max(ids[a], ids[b]), float(1 - product[a])))
        sums[a] += sums[b]
        sizes[a] += sizes[b]
        alive[b] = False
        ids[a] = next_id
        next_id += 1
    return out


def _rest(first_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [x for x in batches if x.num_rows]
        if batches:
            table = pa.Table.from_batches(batches).sort_by("id")
            sums = np.array(table.column("sums").to_pylist(), float).reshape(table.num_rows, -1)
            merged = chain_merges(table.column("id").to_numpy(), sums, table.column("size").to_numpy(), first_id)
            columns = list(zip(*merged, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(),) * 3 + (pa.float64(),), strict=True)], ["id", "a", "b", "height"])

    return run


def merges(vectors: DataFrame, n: int, local_rows: int) -> DataFrame:
    """(id, a, b, height) of the n - 1 merges of the tree over (id, vector), ids being 0 .. n - 1; a merged cluster's id is
    larger than those of its parts, and its height not below theirs. Vectors of length 0 are at distance 1 from all."""
    rows = vectors.select("id", F.lit(1).cast("long").alias("size"), scoring.unit(F.col("vector").cast("array<double>")).alias("sums"))
    clusters = asked = cut(rows)
    alive, n_asked, k, found, known = n, n, 0, [], None
    while alive > max(1, local_rows):
        k += 1
        new = nearest(asked, clusters, n_asked, alive)
        # dealt anew, as each union would add the partitions of both sides
        known = cut((known.unionByName(new) if known is not None else new).repartition("id"))
        back = known.select(F.col("id").alias("other"), F.col("other").alias("id"))
        pairs = known.where("id < other").join(back, ["id", "other"])
        pairs = cut(pairs.select(F.col("id").alias("a"), F.col("other").alias("b"), "product").repartition("a"))
        m = pairs.count()
        if not m:  # rounding made a circle of equals: the nearest pair of all merges
            best = known.orderBy(F.desc("product"), F.least("id", "other"), F.greatest("id", "other")).limit(1)
            pairs, m = cut(best.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "product")), 1
        # of a round and the smaller of the two smallest rows in it: no other merge has both
        merged = pairs.withColumn("new", F.least(F.col("a") % n, F.col("b") % n) + F.lit(n) * k)
        side = lambda c: clusters.select(F.col("id").alias(c), F.col("size").alias(f"{c}_size"), F.col("sums").alias(f"{c}_sums"))  # noqa: B023, E731
        joined = merged.join(side("a"), "a").join(side("b"), "b")
        fresh = cut(joined.select(F.col("new").alias("id"), (F.col("a_size") + F.col("b_size")).alias("size"), F.zip_with("a_sums", "b_sums", lambda x, y: x + y).alias("sums")))
        found.append(merged.select(F.col("new").alias("id"), "a", "b", (1 - F.col("product")).alias("height")))
        gone = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")))
        left = cut(clusters.join(gone, "id", "left_anti"))
        clusters = cut(left.unionByName(fresh).repartition("id"))
        known = cut(known.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "other"), "other", "left_anti").select("id", "other", "product"))
        asked = cut(fresh.unionByName(left.join(known, "id", "left_anti")).repartition("id"))
        alive, n_asked = alive - m, asked.count()
    found.append(clusters.coalesce(1).mapInArrow(_rest(n * (k + 1)), "id long, a long, b long, height double"))  # local_rows at most
    tree = found[0]
    for part in found[1:]:
        tree = tree.unionByName(part)
    return tree
