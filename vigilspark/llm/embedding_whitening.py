"""Embedding whitening with MLlib's BlockMatrix.

Entries are read as whole numbers (``floor(SCALE * entry) + OFFSET``).  Each distinct
vector counts once in the fit.  The centred rows get consecutive numbers and become
blocks of a BlockMatrix A; ``A.transpose().multiply(A)`` is the scatter matrix, whose
eigenvectors (``numpy.linalg.eigh`` on the driver: dimensions squared, whatever the
rows) give the whitening matrix; a BlockMatrix product with it projects the rows.

For the scatter the blocks stand in one column, and the product's middle dimension
is split so that each task holds a few blocks (MLlib deals a product by its result,
here one block, unless told so).  For the projection the same blocks stand on a square
grid, times a block-diagonal matrix of whitening matrices: MLlib's grid partitioner
takes the square root of the partitions in each direction, and a single column of
blocks would use the square root of them all.  MLlib brings the blocks' coordinates
(two numbers per ``BLOCK_BYTES`` of rows) to the driver; no row goes there.

Defined cases: rows whose vector is null or holds null, NaN or infinite entries are
left out, and so are vectors of another length than the most frequent one (ties: the
longer); repeated rows give their rows each and count once in the fit; rows without
an id take part; components of no variance (eigenvalue below 1e-12 of the largest, or
none for a single distinct vector) are not returned; an empty table gives no rows;
``deviation`` is null where the exact value exceeds a long; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
BLOCK_BYTES = 2 << 20   # of centred rows
SPLIT_BLOCKS = 8        # blocks of each side in a task of the scatter product


def whole_vectors(table: DataFrame, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """(id, x): the usable rows, entries as long."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    usable = table.where(v.isNotNull() & ~bad).select(F.col(id_col).alias("id"), v.alias("v"))
    return usable.select("id", F.transform("v", lambda c: F.floor(SCALE * c.cast("double")).cast("long") + F.lit(OFFSET).cast("long")).alias("x"))


def numbered(rows: DataFrame, kind: str) -> tuple[DataFrame, int]:
    """``rows`` with consecutive numbers ``at`` from 0, and their count; one number per task is collected."""
    start = F.monotonically_increasing_id()
    d = stage(rows.select("*", F.shiftright(start, 33).alias("part"), start.bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")), kind)
    sizes = sorted((r["part"], r["count"]) for r in d.groupBy("part").count().collect())
    firsts, total = [], 0
    for part, size in sizes:
        firsts.append((part, total))
        total += size
    offsets = d.sparkSession.createDataFrame(firsts, "part long, first long")
    return d.join(F.broadcast(offsets), "part").withColumn("at", F.col("first") + F.col("nth")).drop("part", "first", "nth"), total


def _pack(rows_per_block, dims, id_type):
    def run(key, table):
        table = table.sort_by("at")
        flat = table.column("centred").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        full = np.zeros((rows_per_block, dims))  # only the last block has rows to spare, which stay zero
        full[:table.num_rows] = flat.reshape(-1, dims)

        def whole(name, kind):
            return pa.array([table.column(name).to_pylist()], pa.list_(kind))
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), whole("id", id_type), whole("deviation", pa.int64()),
                                          pa.array([full.tobytes()], pa.binary())], ["block", "ids", "deviations", "rows"])
    return run


class Blocks:
    """Centred rows as a table of blocks (block, ids, deviations, rows) with their shape."""

    def __init__(self, x: DataFrame, n: int, sums: list[int], kind: str):
        spark, self.dims = x.sparkSession, len(sums)
        self.height = max(1, BLOCK_BYTES // (8 * self.dims))
        rows, total = numbered(x, f"{kind}-rows")
        self.count = max(1, -(-total // self.height))
        means = F.array(*[F.lit(s).cast("long") for s in sums])
        apart = rows.select("at", "id", F.zip_with("x", means, lambda v, s: F.lit(n).cast("long") * v - s).alias("apart"))
        squares = F.aggregate("apart", F.lit(0).cast("long"), lambda acc, v: F.try_add(acc, F.try_multiply(v, v)))
        centred = apart.select("at", "id", squares.alias("deviation"), F.transform("apart", lambda v: v.cast("double") / n).alias("centred"),
                               F.floor(F.col("at") / self.height).alias("block"))
        id_type = spark.createDataFrame([], centred.select("id").schema).toArrow().schema.field("id").type
        schema = f"block long, ids array<{centred.schema['id'].dataType.simpleString()}>, deviations array<long>, rows binary"
        self.table = stage(centred.groupBy("block").applyInArrow(_pack(self.height, self.dims, id_type), schema), f"{kind}-blocks")
        self.side = math.isqrt(self.count - 1) + 1

    def _matrix(self, place, height, width):
        h, d = self.height, self.dims
        blocks = self.table.select("block", "rows").rdd.map(lambda r: (place(r["block"]), DenseMatrix(h, d, np.frombuffer(r["rows"]).reshape(h, d).ravel("F"))))
        return BlockMatrix(blocks, h, d, height * h, width * d)

    def column(self) -> BlockMatrix:
        return self._matrix(lambda b: (b, 0), self.count, 1)

    def grid(self) -> BlockMatrix:
        side = self.side
        return self._matrix(lambda b: (b // side, b % side), -(-self.count // side), side)

    def project(self, matrix: np.ndarray) -> BlockMatrix:
        """The rows times ``matrix``, blocks on the grid."""
        d, c = matrix.shape
        one = DenseMatrix(d, c, matrix.ravel("F"))
        diagonal = self.table.sparkSession.sparkContext.parallelize([((j, j), one) for j in range(self.side)])
        return self.grid().multiply(BlockMatrix(diagonal, d, c, self.side * d, self.side * c))


def scatter(a: BlockMatrix, blocks: int) -> np.ndarray:
    """``a`` transposed times ``a`` (one column of blocks); only the result is collected."""
    splits = max(1, blocks // SPLIT_BLOCKS)
    product = a.transpose()._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, a.colsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def _unpack(height, width, explained, n, error):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids").slice(i, 1).flatten()
                z = np.frombuffer(batch.column("z")[i].as_py()).reshape(height, width)[:len(ids)]
                rows = pa.array(np.repeat(np.arange(len(ids)), width))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(ids))), pa.array(np.full(len(rows), n)),
                     batch.column("deviations").slice(i, 1).flatten().take(rows), pa.array(z.ravel()), pa.array(np.tile(explained, len(ids))),
                     pa.array(np.full(len(rows), error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(table: DataFrame, id_col="vec_id", vector_col="embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row of ``table`` and component: vec_id, component (from 1 by falling
    eigenvalue), n (distinct vectors), deviation (squared distance from the mean, times n
    squared), whitened, explained, identity_error (of the whitened fit vectors)."""
    x = whole_vectors(table, id_col, vector_col)
    schema = (f"vec_id {x.schema['id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    nothing = table.sparkSession.createDataFrame([], schema)
    x = stage(x, "vectors")
    length = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None or not length["d"]:
        return nothing
    d = length["d"]
    x = x.where(F.size("x") == d)
    fit = stage(x.select("x").distinct(), "fit")
    n, *sums = fit.agg(F.count("*"), *[F.sum(F.col("x")[k]) for k in range(d)]).first()
    fit_blocks = Blocks(fit.select(F.lit(None).cast("long").alias("id"), "x"), n, sums, "fit")
    values, vectors = np.linalg.eigh(scatter(fit_blocks.column(), fit_blocks.count) / n)
    order = [k for k in np.argsort(values)[::-1] if values[k] > 1e-12 * max(values.max(), 0)][:components]
    if not order:
        return nothing
    whitening = vectors[:, order] / np.sqrt(values[order])
    c, side = len(order), fit_blocks.side
    z = fit_blocks.project(whitening).blocks.map(lambda b: ((b[0][0] * side + b[0][1], 0), b[1]))
    z = BlockMatrix(z, fit_blocks.height, c, fit_blocks.count * fit_blocks.height, c)
    error = float(np.abs(scatter(z, fit_blocks.count) / n - np.eye(c)).max())
    rows = Blocks(x, n, sums, "all")
    side = rows.side
    projected = rows.project(whitening).blocks.map(lambda b: (b[0][0] * side + b[0][1], bytearray(b[1].toArray().tobytes())))
    projected = table.sparkSession.createDataFrame(projected, "block long, z binary")
    joined = rows.table.select("block", "ids", "deviations").join(projected, "block").select("ids", "deviations", "z")
    return joined.mapInArrow(_unpack(rows.height, c, values[order] / values.sum(), n, error), schema)
