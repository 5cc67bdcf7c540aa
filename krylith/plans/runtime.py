"""Matrix operators for iterative methods: one in memory for small systems, one over row blocks.

Small systems (a checked number of entries) run in numpy on the driver. Larger ones are packed once
into row blocks that stay cached; a product broadcasts the vector, whose length the caller
bounds, and computes each block's rows in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCAL_ENTRIES = 5_000_000


def scattered(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    if np.iscomplexobj(values):
        return np.bincount(at, values.real, n) + 1j * np.bincount(at, values.imag, n)
    return np.bincount(at, values, n)


class LocalOperator:
    """Entries (i, j, v), real or complex, as arrays on the driver."""

    def __init__(self, i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int):
        self.i, self.j, self.v, self.n = i, j, v, n

    def dot(self, x: np.ndarray) -> np.ndarray:
        return scattered(self.i, self.v * x[self.j], self.n)

    def dot_h(self, x: np.ndarray) -> np.ndarray:
        return scattered(self.j, np.conj(self.v) * x[self.i], self.n)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.i, self.j, self.v

    def diagonal(self) -> np.ndarray:
        at = self.i == self.j
        return scattered(self.i[at], self.v[at], self.n)

    def diagonal_blocks(self, size: int) -> np.ndarray:
        """The dense diagonal blocks of size rows; beyond the matrix they go on as the identity."""
        count = -(-self.n // size)
        out = np.zeros((count, size, size), self.v.dtype)
        at = self.i // size == self.j // size
        np.add.at(out, (self.i[at] // size, self.i[at] % size, self.j[at] % size), self.v[at])
        tail = np.arange(self.n, count * size)
        out[tail // size, tail % size, tail % size] = 1
        return out

    def dense(self) -> np.ndarray:
        out = np.zeros((self.n, self.n), self.v.dtype)
        np.add.at(out, (self.i, self.j), self.v)
        return out


class BlockOperator:
    """Rows of a matrix in blocks of block_rows."""

    def __init__(self, a: DataFrame, n: int, block_rows: int = 10_000):
        self.n, self.a = n, a
        packed = a.groupBy(F.floor(F.col("i") / block_rows).alias("block")).agg(F.collect_list(F.struct("i", "j", "v")).alias("e"))
        self.blocks = packed.select("e.i", "e.j", "e.v").persist(StorageLevel.MEMORY_AND_DISK)

    def product(self, x: np.ndarray, rows: int, cols: int) -> np.ndarray:
        sent = self.blocks.sparkSession.sparkContext.broadcast(x)

        def run(batches):
            for batch in batches:
                parts = [np.asarray(batch.column(k).flatten()) for k in range(3)]
                keys, inverse = np.unique(parts[rows], return_inverse=True)
                y = np.bincount(inverse, parts[2] * sent.value[parts[cols]], keys.size)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(y)], ["i", "v"])

        found = self.blocks.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        sent.unpersist()
        out = np.zeros(self.n)
        out[found["i"].to_numpy()] = found["v"].to_numpy()
        return out

    def diagonal(self) -> np.ndarray:
        found = self.a.where("i = j").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros(self.n)
        out[found["i"].to_numpy(np.int64)] = found["v"].to_numpy()
        return out

    def diagonal_blocks(self, size: int) -> np.ndarray:
        """As of the local operator: size numbers for each row reach the driver."""
        near = self.a.where(F.floor(F.col("i") / size) == F.floor(F.col("j") / size)).select("i", "j", "v").toPandas()
        return LocalOperator(near["i"].to_numpy(np.int64), near["j"].to_numpy(np.int64), near["v"].to_numpy(float), self.n).diagonal_blocks(size)

    def dot(self, x: np.ndarray) -> np.ndarray:
        return self.product(x, 0, 1)

    def dot_h(self, x: np.ndarray) -> np.ndarray:
        return self.product(x, 1, 0)


def operator(a: DataFrame, n: int, limit: int = LOCAL_ENTRIES):
    """The local operator if at most limit entries are stored, else the blocked one."""
    head = a.select("i", "j", "v").limit(limit + 1).toPandas()
    if len(head) <= limit:
        return LocalOperator(head["i"].to_numpy(np.int64), head["j"].to_numpy(np.int64), head["v"].to_numpy(float), n)
    return BlockOperator(a, n)
