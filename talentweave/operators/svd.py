"""Truncated singular value decomposition of a sparse matrix by randomised subspace iteration.

The matrix is a table of entries (row, column, value). A random start is multiplied by the matrix and its transpose in turn;
what is kept between the steps is a tall table of rows (key, vector of `size` numbers), and it is made orthonormal by the
Cholesky factor of its Gram matrix, the only thing that reaches the driver, `size` squared numbers. A product joins the
entries with the rows in blocks of the inner key, and partial sums are added before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

#: Directions beyond those asked for, and rounds of the iteration.
EXTRA = 16
ROUNDS = 6
#: Inner keys of a block of a product.
BLOCK_KEYS = 4_096


def _product(entries: DataFrame, to: str, inner: str, tall: DataFrame, n_inner: int) -> DataFrame:
    """(key, vector): for each `to`, the sum over its entries of value times the row of `tall` at the entry's `inner`."""
    parts = max(1, -(-n_inner // BLOCK_KEYS), entries.sparkSession.sparkContext.defaultParallelism)
    key = entries.schema[to].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, at = right.column("t_key").combine_chunks(), left.column("inner").combine_chunks()
        if not len(keys) or not len(at):
            return pa.table({"key": left.column("to").slice(0, 0), "vector": pa.array([], pa.list_(pa.float64()))})
        rows = np.array(right.column("t_vector").to_pylist())
        place = pc.index_in(at, keys).to_numpy(zero_copy_only=False)
        value = left.column("value").to_numpy()
        names = left.column("to").combine_chunks().dictionary_encode()
        code = names.indices.to_numpy()
        out = np.zeros((len(names.dictionary), rows.shape[1]))
        order = np.argsort(code, kind="stable")
        for some in np.array_split(order, max(1, len(order) * rows.shape[1] // (1 << 24))):
            np.add.at(out, code[some], value[some, None] * rows[place[some]])
        return pa.table({"key": names.dictionary, "vector": pa.array(list(out), pa.list_(pa.float64()))})

    block = lambda c: F.pmod(F.xxhash64(c), F.lit(parts))
    left = entries.select(block(inner).alias("part"), F.col(inner).alias("inner"), F.col(to).alias("to"), "value")
    right = tall.select(block("key").alias("t_part"), F.col("key").alias("t_key"), F.col("vector").alias("t_vector"))
    partial = left.groupBy("part").cogroup(right.groupBy("t_part")).applyInArrow(run, f"key {key}, vector array<double>")

    def added(table: pa.Table) -> pa.Table:
        return pa.table({"key": table.column("key").slice(0, 1), "vector": pa.array([np.array(table.column("vector").to_pylist()).sum(axis=0)], pa.list_(pa.float64()))})

    return partial.groupBy("key").applyInArrow(added, f"key {key}, vector array<double>")  # a row for each block at most


def _gram(tall: DataFrame, size: int) -> np.ndarray:
    """Products of all pairs of columns of a tall table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            rows = np.array(batch.column(0).to_pylist()).reshape(-1, size)
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["line", "sums"])

    parts = tall.select("vector").mapInArrow(run, "line int, sums array<double>")
    sums = parts.select("line", F.posexplode("sums").alias("k", "x")).groupBy("line", "k").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros((size, size))
    out[sums.column("line").to_numpy(), sums.column("k").to_numpy()] = sums.column("x").to_numpy()
    return out


def _times(tall: DataFrame, matrix: np.ndarray) -> DataFrame:
    """A tall table times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array(batch.column(1).to_pylist()).reshape(batch.num_rows, -1) @ matrix
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(rows), pa.list_(pa.float64()))], ["key", "vector"])

    return tall.mapInArrow(run, f"key {tall.schema['key'].dataType.simpleString()}, vector array<double>")


def _orthonormal(tall: DataFrame, size: int) -> DataFrame:
    """The same column space with orthonormal columns; directions that are lost in rounding become 0."""
    values, vectors = np.linalg.eigh(_gram(tall, size))
    good = values > values.max(initial=0) * 1e-13
    scale = np.where(good, 1 / np.sqrt(np.where(good, values, 1)), 0)
    return cut(_times(tall, vectors * scale))


def truncated(entries: DataFrame, n_rows: int, n_columns: int, components: int, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(row, vector) of left singular vectors times singular values, and these values, largest first.

    `entries` has (row, column, value), each cell once. Rows without an entry aren't listed; an empty table gives none.
    """
    size = min(components + EXTRA, n_rows, n_columns)
    key = entries.schema["column"].dataType.simpleString()
    columns = entries.select(F.col("column").alias("key")).distinct()

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # depends on the keys alone, so a task that runs again gives the same
            rows = [np.random.default_rng(k).standard_normal(size) for k in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["key", "vector"])

    seeded = columns.withColumn("seed", F.shiftrightunsigned(F.xxhash64("key"), 1))
    right = seeded.mapInArrow(start, f"key {key}, vector array<double>")
    for _ in range(rounds):
        left = _orthonormal(cut(_product(entries, "row", "column", right, n_columns)), size)
        right = _orthonormal(cut(_product(entries, "column", "row", left, n_rows)), size)
    last = cut(_product(entries, "row", "column", right, n_columns))
    values, vectors = np.linalg.eigh(_gram(last, size))
    order = np.argsort(-values)[:components]
    return _times(last, vectors[:, order]).withColumnRenamed("key", "row"), np.sqrt(np.maximum(values[order], 0))
