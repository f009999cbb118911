"""Whitening of embeddings with MLlib's BlockMatrix.

Vectors become exact integers first.  The distinct vectors are the fit list; its sums give the
centre, and the centred rows are packed into dense blocks, written once and read as a BlockMatrix.
Its transpose times itself is the scatter matrix, whose eigenvectors are found on the driver (it is
dimensions by dimensions, whatever the number of rows).  The blocks times the whitening matrix give
the whitened rows.  Rows whose vector is already in the fit list are packed and multiplied likewise,
so nothing is joined by vector and a vector that a third of all rows share is no hot key.

MLlib sends all blocks of a result partition to one task, so both multiplications are split by the
number of blocks: the scatter along its middle dimension, the projection by empty partitions of its
right side.  A task holds about :data:`BLOCKS` blocks of half a million numbers.  The driver gets the
block coordinates from MLlib (one pair per block, not per row), the sums and the scatter.

Defined results:

* rows whose vector is null, empty, or holds null, non-finite or not exactly representable entries
  (64 c of 2^52 or more) are dropped; so are vectors that have not the commonest length (of equally
  common ones the longer);
* repeated rows and ids stay, each with its own result rows; the fit list has each vector once;
* directions without variance (below 1e-10 of the largest) are no components, so a single distinct
  vector or an empty table gives no rows;
* deviations beyond a long are null; sums beyond a long are an error;
* further columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import ship, written_table

SCALE, SHIFT = 64, 1_000_000
#: Numbers in a block, and blocks a task multiplies at a time.
NUMBERS, BLOCKS = 1 << 19, 4
#: Smallest eigenvalue of a component, as a part of the largest.
LEAST = 1e-10
_MATRIX = "struct<type:tinyint,numRows:int,numCols:int,colPtrs:array<int>,rowIndices:array<int>,values:array<double>,isTransposed:boolean>"


def quantised(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(rid, key, x): integer vectors with a row number of their own, written once."""
    v = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double") * SCALE)
    rows = rows.select(F.col(f"`{key}`").cast("long").alias("key"), v.alias("v")).filter(F.size("v") > 0)
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(1 << 52)))
    rows = rows.filter(F.col("v").isNotNull() & ~bad)
    return written_table(rows.select(F.monotonically_increasing_id().alias("rid"), "key", F.transform("v", lambda c: F.floor(c) + SHIFT).alias("x")))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), dims)


def column_sums(fit: DataFrame, dims: int) -> tuple[int, np.ndarray, int]:
    """Rows, sums per dimension and largest absolute entry; one partial row per task, added up by dimension."""
    def run(batches: Iterator) -> Iterator:
        n, sums, most = 0, [0] * dims, 0
        for b in batches:
            if b.num_rows:
                m = _matrix(b, dims)
                n, most = n + len(m), max(most, int(np.abs(m).max()))
                sums = [s + int(v) for s, v in zip(sums, m.sum(axis=0))] if most < (1 << 62) // len(m) else [s + sum(map(int, c)) for s, c in zip(sums, m.T)]
        if n:
            if max(map(abs, sums)) >= 1 << 63:
                raise ArithmeticError("sums beyond a long")
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "most": pa.array([most], pa.int64()), "s": pa.array([sums], pa.list_(pa.int64()))})

    parts = fit.select("x").mapInArrow(run, "n long, most long, s array<long>")
    per = parts.select("n", "most", F.posexplode("s").alias("dim", "s")).groupBy("dim").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.sum("s").alias("s")).orderBy("dim").collect()
    return per[0]["n"], np.array([r["s"] for r in per], dtype=np.int64), per[0]["most"]


def _exact_squares(q: np.ndarray) -> list:
    """Sums of squares as exact longs, null where they exceed one."""
    near = (q.astype(float) ** 2).sum(axis=1)
    sure = near < 9.2e18
    exact = (np.where(sure[:, None], q, 0) ** 2).sum(axis=1)
    return [int(e) if ok else None for e, ok in zip(exact, sure)]


def packed(rows: DataFrame, n: int, sums: np.ndarray, per_block: int) -> tuple[DataFrame, DataFrame, int]:
    """Centred rows as blocks, written once: (block, keys, deviations), (at, matrix), and the number of blocks.

    Tasks number their own blocks; the blocks of the tasks before are added from one count per task.
    The last block of a task is filled up with rows of zeros.
    """
    dims = len(sums)

    def block(keys: list, q: np.ndarray, k: int, part: int) -> pa.RecordBatch:
        full = np.zeros((per_block, dims))
        full[: len(q)] = q / n
        one = {"type": 1, "numRows": per_block, "numCols": dims, "colPtrs": None, "rowIndices": None, "values": full.ravel(), "isTransposed": True}
        fields = [("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())), ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())]
        values = pa.ListArray.from_arrays(pa.array([0, full.size], pa.int32()), pa.array(one.pop("values")))
        cols = [values if name == "values" else pa.array([one[name]], t) for name, t in fields]
        return pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "k": pa.array([k], pa.int64()), "keys": pa.array([keys], pa.list_(pa.int64())),
            "deviations": pa.array([_exact_squares(q)], pa.list_(pa.int64())), "matrix": pa.StructArray.from_arrays(cols, fields=[pa.field(*f) for f in fields])})

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        part, k, keys, left = TaskContext.get().partitionId(), 0, [], np.zeros((0, dims), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            left, keys = np.vstack([left, n * _matrix(b, dims) - sums]), keys + b.column("key").to_pylist()
            while len(left) >= per_block:
                yield block(keys[:per_block], left[:per_block], k, part)
                left, keys, k = left[per_block:], keys[per_block:], k + 1
        if len(left):
            yield block(keys, left, k, part)

    table = written_table(rows.select("key", "x").mapInArrow(run, f"part int, k long, keys array<long>, deviations array<long>, matrix {_MATRIX}"))
    counts = {r["part"]: r["n"] for r in table.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    offsets = table.sparkSession.createDataFrame(starts or [(0, 0)], "part int, start long")
    if not total:
        return table.select(F.col("k").alias("block"), "keys", "deviations"), table, 0
    # the same table once more, with MLlib's own type for the struct: no Python on the way into the matrix
    typed = StructType([StructField("part", IntegerType()), StructField("k", LongType()), StructField("matrix", MatrixUDT())])
    typed = table.sparkSession.read.schema(typed).parquet(os.path.dirname(table.inputFiles()[0]))
    at = F.struct((F.col("start") + F.col("k")).alias("_1"), F.lit(0).cast("long").alias("_2"))
    # one row per task of the write
    offsets = F.broadcast(offsets)
    return (table.join(offsets, "part").select((F.col("start") + F.col("k")).alias("block"), "keys", "deviations"),
            typed.join(offsets, "part").select(at.alias("at"), "matrix"), total)


def block_matrix(blocks: DataFrame, n_blocks: int, per_block: int, dims: int) -> BlockMatrix:
    """(at, matrix) as MLlib's matrix."""
    return BlockMatrix(callMLlibFunc("createBlockMatrix", blocks, per_block, dims, n_blocks * per_block, dims), per_block, dims)


def scatter(a: BlockMatrix, n_blocks: int) -> np.ndarray:
    """Transpose times matrix, cut along the rows into so many parts that a task holds few blocks."""
    t, parts = a.transpose(), -(-n_blocks // BLOCKS)
    java = t._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(java, t.rowsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def projected(a: BlockMatrix, n_blocks: int, w: np.ndarray) -> DataFrame:
    """(block, matrix) of the rows times ``w``."""
    sc, (dims, k) = a._java_matrix_wrapper._sc, w.shape
    right = BlockMatrix(sc.parallelize([((0, 0), DenseMatrix(dims, k, w.T.ravel().tolist()))], max(1, -(-n_blocks // BLOCKS))), dims, k, dims, k)
    out = callMLlibFunc("getMatrixBlocks", a.multiply(right)._java_matrix_wrapper._java_model)
    return out.toDF("at", "matrix").select(F.col("at._1").alias("block"), "matrix")


@dataclass
class Whitening:
    """Rows and integer sums of the fit list, falling eigenvalues, unit components in columns and the trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def matrix(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def eigen(s: np.ndarray, n: int, sums: np.ndarray, most: int) -> Whitening:
    v = (s + s.T) / (2 * n)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = min(most, int((values > max(values[0], 0.0) * LEAST).sum())) if values[0] > 0 else 0
    return Whitening(n, sums, values[:keep], vectors[:, :keep], float(np.trace(v)))


def _expanded(blocks: DataFrame, k: int) -> DataFrame:
    """Blocks of whitened rows to one row per key and component."""
    def run(batches: Iterator) -> Iterator:
        for b in batches:
            for i in range(b.num_rows):
                keys, dev = b.column("keys")[i].values, b.column("deviations")[i].values
                w = b.column("matrix")[i]["values"].values.to_numpy().reshape(k, -1)[:, : len(keys)]
                order = np.repeat(np.arange(len(keys)), k)
                yield pa.RecordBatch.from_pydict({"key": keys.take(pa.array(order)), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(keys))), "deviation": dev.take(pa.array(order)), "whitened": pa.array(w.T.ravel())})

    return blocks.select("keys", "deviations", "matrix").mapInArrow(run, "key long, component int, deviation long, whitened double")


def _second_moments(blocks: DataFrame, k: int) -> np.ndarray:
    """Sum of the outer products of whitened rows: one k by k part per task."""
    def run(batches: Iterator) -> Iterator:
        total = np.zeros((k, k))
        for b in batches:
            for m in b.column("matrix"):
                w = m["values"].values.to_numpy().reshape(k, -1)
                total += w @ w.T
        yield pa.RecordBatch.from_pydict({"v": pa.array([total.ravel()], pa.list_(pa.float64()))})

    parts = blocks.select("matrix").mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("at", "v"))
    return np.array([r["v"] for r in parts.groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()]).reshape(k, k)


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 16) -> tuple[DataFrame, Whitening | None, float]:
    """(key, component, deviation, whitened) of every valid row, the model and the identity error.

    ``most`` components at most.  Without any component the frame is empty and the model may be None.
    """
    spark = rows.sparkSession
    ship(spark)
    none = spark.createDataFrame([], "key long, component int, deviation long, whitened double")
    all_rows = quantised(rows, key, vector)
    size = all_rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if size is None:
        return none, None, 0.0
    dims = size["d"]
    all_rows = all_rows.filter(F.size("x") == dims)
    fit = written_table(all_rows.groupBy("x").agg(F.min(F.struct("rid", "key")).alias("r")).select("r.rid", "r.key", "x"))
    n, sums, top = column_sums(fit, dims)
    if 2 * n * top >= 1 << 63:
        raise ArithmeticError("n * x beyond a long")
    per_block = max(1, min(NUMBERS // dims, n))
    blocks, matrices, n_blocks = packed(fit, n, sums, per_block)
    a = block_matrix(matrices, n_blocks, per_block, dims)
    model = eigen(scatter(a, n_blocks), n, sums, most)
    k = len(model.values)
    if not k:
        return none, model, 0.0
    parts = [(blocks, projected(a, n_blocks, model.matrix))]
    if n < size["n"]:
        rest, matrices, n_rest = packed(all_rows.join(fit.select("rid"), "rid", "left_anti"), n, sums, per_block)
        parts.append((rest, projected(block_matrix(matrices, n_rest, per_block, dims), n_rest, model.matrix)))
    done = [written_table(b.join(p, "block")) for b, p in parts]
    error = float(np.abs(_second_moments(done[0], k) / n - np.eye(k)).max())
    out = _expanded(done[0], k)
    for d in done[1:]:
        out = out.unionByName(_expanded(d, k))
    return out, model, error
