"""Centroid clustering by sort-means on integer vectors, exactly.

Each round sorts, for each centroid a, the other centroids by their distance from a. A vector that was last assigned to a
looks at them in this order and stops at the first that is strictly more than twice as far from a as the vector is: by the
triangle inequality it and all behind it are strictly farther from the vector than a. Ties go to the smaller number, so
equality doesn't stop. Distances are squared and integer, so twice as far is four times as much, and nothing is rounded.

Vectors carry their last assignment and distance from round to round in a table of the shared folder. A round reads it
once, writes the next one, and sums components per cluster; K rows of sums reach the driver, however many vectors there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

CLUSTERS = 16
ROUNDS = 3
SIZE = 64
SCALE = 64
#: Largest component after scaling, so that a squared distance of `SIZE` components fits 64 bits.
LARGEST = 1 << 27
_ROWS = 4096


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(id, v) of the vectors with exactly `size` components, none of them null or not finite: floor(scale * x) of each.
    Other rows are left out; a component beyond `LARGEST` is an error, as distances wouldn't fit."""
    vector = vectors[vector_col]
    number = lambda x: x.cast("double")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < F.lit(float("inf"))))
    scaled = lambda x: number(x) * F.lit(float(scale))
    fits = F.forall(vector, lambda x: F.abs(scaled(x)) <= F.lit(float(LARGEST)))
    rows = vectors.where((F.size(vector) == size) & finite)
    checked = F.when(fits, vector).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} / {scale}")))
    return rows.select(rows[id_col].alias("id"), F.transform(checked, lambda x: F.floor(scaled(x)).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS, seed: int = 1) -> np.ndarray:
    """The vectors with the smallest sha256 of `seed:id`; of rows that share an id the smaller vectors come first, and rows
    without an id are taken last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    chosen = rows.withColumn("order", order).orderBy(F.asc_nulls_last("order"), "v").limit(clusters).select("v").collect()
    return np.array([r["v"] for r in chosen], np.int64)


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the numbers of all by squared distance from it, and these distances."""
    apart = np.array([((centroids - c) ** 2).sum(axis=1) for c in centroids])
    order = np.argsort(apart, axis=1, kind="stable")
    return order, np.take_along_axis(apart, order, axis=1)


def nearest(x: np.ndarray, last: np.ndarray, centroids: np.ndarray, order: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of every row of `x`, whose last clusters are given, and the distances computed."""
    cluster, distance = last.copy(), np.zeros(len(x), np.int64)
    computed = len(x)
    for a in np.unique(last):
        rows = np.flatnonzero(last == a)
        own = ((x[rows] - centroids[a]) ** 2).sum(axis=1)
        far = np.argsort(-own, kind="stable")  # who looks far comes first, so those who still look are a prefix
        rows, own = rows[far], own[far]
        best, at = own.copy(), np.full(len(rows), a)
        for c, away in zip(order[a], apart[a], strict=True):
            if c == a:
                continue
            n = int(np.searchsorted(-4 * own, -away, "right"))  # 4 * own >= away
            if not n:
                break
            to = ((x[rows[:n]] - centroids[c]) ** 2).sum(axis=1)
            computed += n
            better = (to < best[:n]) | ((to == best[:n]) & (c < at[:n]))
            best[:n][better], at[:n][better] = to[better], c
        cluster[rows], distance[rows] = at, best
    return cluster, distance, computed


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, apart = neighbours(centroids)
        for batch in batches:
            for begin in range(0, batch.num_rows, _ROWS):
                part = batch.slice(begin, _ROWS)
                x = part.column(1).flatten().to_numpy().astype(np.int64).reshape(part.num_rows, -1)
                cluster, distance, _ = nearest(x, part.column(2).to_numpy(), centroids, order, apart)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["id", "v", "cluster", "distance"])

    return run


def moved(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of the mean of each cluster's vectors, component by component; empty clusters stay where they are."""
    sums = [F.sum(F.get("v", F.lit(k)).cast("long")).alias(f"s{k}") for k in range(centroids.shape[1])]
    after = centroids.copy()
    for row in assigned.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        after[row["cluster"]] = [row[f"s{k}"] // row["n"] for k in range(centroids.shape[1])]
    return after


def cluster(vectors: DataFrame, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(id, v, cluster, distance) of every kept vector after `rounds` rounds and a last assignment, and the centroids.

    Which vectors are kept, see `integer_vectors`. Rows that repeat an id are vectors of their own; with fewer vectors than
    `clusters` each is a centroid; equal centroids go by the smaller number; without a kept vector there are no rows and no
    centroids. Other columns aren't read.
    """
    key = vectors.schema[id_col].dataType.simpleString()
    rows = scratch.save(integer_vectors(vectors, id_col, vector_col, size, scale), "vectors")
    centroids = first_centroids(rows, clusters, seed)
    now = rows.withColumn("cluster", F.lit(0))
    schema = f"id {key}, v array<int>, cluster int, distance bigint"
    if not len(centroids):
        return now.withColumn("distance", F.lit(0).cast("long")), centroids
    for k in range(rounds + 1):
        now = scratch.save(now.select("id", "v", "cluster").mapInArrow(_assign(centroids), schema), f"assigned_{k}")
        scratch.drop(f"assigned_{k - 1}" if k else "vectors")
        if k < rounds:
            centroids = moved(now, centroids)
    return now, centroids


def digest(centroid: Column) -> Column:
    """sha256 of the components of a centroid in decimal, joined by commas."""
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ",").cast("binary"), 256)


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`assigned` with the distances summed over each cluster and over all, and each cluster's centroid. The table that is
    broadcast has a row for each centroid."""
    spark = assigned.sparkSession
    table = spark.createDataFrame([(k, [int(x) for x in line]) for k, line in enumerate(centroids)], "cluster int, centroid array<bigint>")
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    lines = spark.createDataFrame([(k, s, sum(sums.values())) for k, s in sums.items()], "cluster int, cluster_inertia bigint, inertia bigint")
    return assigned.join(F.broadcast(lines.join(table, "cluster")), "cluster")


#: The same in SQL, with every vector against every centroid, for the registered query.
def _rounds_sql(rounds: int) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""d{k} AS (SELECT r, c, sum((x.v - m.v) * (x.v - m.v)) AS d FROM x JOIN m{k} m USING (i) GROUP BY r, c),
    a{k} AS (SELECT r, c, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, c) AS place FROM d{k}) WHERE place = 1)""")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT c, i, sum(v)::HUGEINT AS s, count(*) AS n FROM a{k} JOIN x USING (r) GROUP BY c, i),
    m{k + 1} AS (SELECT c, i, coalesce(((s - (s % n + n) % n) // n)::BIGINT, v) AS v FROM m{k} LEFT JOIN s{k} USING (c, i))""")
    return ",\n    ".join(steps)


ORACLE = f"""WITH kept AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
      WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {SIZE}),
    x AS (SELECT r, i, floor({SCALE} * embedding[i]::DOUBLE)::BIGINT AS v FROM kept, (SELECT unnest(range(1, {SIZE + 1})) AS i)),
    chosen AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {CLUSTERS}),
    m0 AS (SELECT c, i, v FROM chosen JOIN x USING (r)),
    {_rounds_sql(ROUNDS)},
    hashes AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS h FROM m{ROUNDS} GROUP BY c)
    SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
    FROM a{ROUNDS} JOIN kept USING (r) JOIN hashes USING (c)"""
