"""Sparse matrices as DataFrames (i, j, v): products, sums, scaling, splitting and storage views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assemble(entries: DataFrame, add: bool = True) -> DataFrame:
    """entries: seq, i, j, v. One entry for each place: the sum, or the last by seq."""
    return entries.groupBy("i", "j").agg((F.sum("v") if add else F.max_by("v", "seq")).alias("v"))


def matvec(a: DataFrame, x: DataFrame) -> DataFrame:
    """A x; rows without a stored entry that meets x are absent. Entries are joined on their column and summed before the shuffle by row."""
    return a.join(x.select(F.col("i").alias("j"), F.col("v").alias("xv")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("xv")).alias("v"))


def matvech(a: DataFrame, x: DataFrame) -> DataFrame:
    return matvec(transpose(a), x)


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def axpy(alpha: float, a: DataFrame, b: DataFrame) -> DataFrame:
    """alpha A + B, also for sparse matrices."""
    return a.select("i", "j", (alpha * F.col("v")).alias("v")).unionByName(b.select("i", "j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))


def xpay(a: DataFrame, alpha: float, b: DataFrame) -> DataFrame:
    return axpy(alpha, b, a)


def matmat(a: DataFrame, b: DataFrame) -> DataFrame:
    """A B: joined on the inner index, summed before the shuffle by place."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("bj"), F.col("v").alias("bv"))
    return a.select("i", F.col("j").alias("k"), "v").join(right, "k").groupBy("i", F.col("bj").alias("j")).agg(F.sum(F.col("v") * F.col("bv")).alias("v"))


def gram(a: DataFrame, salts: int = 16) -> DataFrame:
    """A^T A: only places on and above the diagonal are multiplied out, and then mirrored.

    A row's entries meet in pairs; one side carries a salt, the other goes to each salt, so a heavy row is worked on by `salts` tasks.
    """
    left = a.select("i", F.col("j").alias("p"), F.col("v").alias("pv"), F.pmod(F.hash("j"), F.lit(salts)).alias("salt"))
    right = a.select("i", F.col("j").alias("q"), F.col("v").alias("qv"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    upper = left.join(right, ["i", "salt"]).where("p <= q").groupBy("p", "q").agg(F.sum(F.col("pv") * F.col("qv")).alias("v"))
    mirrored = F.when(F.col("p") < F.col("q"), F.array(F.struct(F.col("p").alias("i"), F.col("q").alias("j")), F.struct(F.col("q").alias("i"), F.col("p").alias("j")))).otherwise(F.array(F.struct(F.col("p").alias("i"), F.col("q").alias("j"))))
    return upper.select(F.explode(mirrored).alias("e"), "v").select("e.i", "e.j", "v")


def diagonal(a: DataFrame) -> DataFrame:
    return a.where("i = j").select("i", "v")


def shift_diagonal(a: DataFrame, sigma: float) -> DataFrame:
    """A - sigma I; a row without a stored diagonal stays as it is."""
    return a.select("i", "j", F.when(F.col("i") == F.col("j"), F.col("v") - sigma).otherwise(F.col("v")).alias("v"))


def shift_matrix(a: DataFrame, b: DataFrame, sigma: float) -> DataFrame:
    return axpy(-sigma, b, a)


def scale(a: DataFrame, symmetric: bool = False) -> DataFrame:
    """D^-1 A, or with d = 1/sqrt|a_ii| d A d."""
    d = diagonal(a).select(F.col("i").alias("r"), F.col("v").alias("d"))
    if not symmetric:
        return a.join(d, F.col("i") == F.col("r")).select("i", "j", (F.col("v") / F.nullif("d", F.lit(0.0))).alias("v"))
    root = d.select("r", (1 / F.sqrt(F.abs(F.nullif("d", F.lit(0.0))))).alias("d"))
    left = a.join(root, F.col("i") == F.col("r")).select("i", "j", (F.col("v") * F.col("d")).alias("v"))
    return left.join(root, F.col("j") == F.col("r")).select("i", "j", (F.col("v") * F.col("d")).alias("v"))


def split(a: DataFrame, part: str) -> DataFrame:
    """part: l, d or u."""
    return a.where({"l": "i > j", "d": "i = j", "u": "i < j"}[part])


def merge(*parts: DataFrame) -> DataFrame:
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def normf(a: DataFrame) -> DataFrame:
    return a.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("value"))


def set_existing(a: DataFrame, updates: DataFrame) -> DataFrame:
    """updates: seq, i, j, v. Overwrites entries that are stored; others are ignored."""
    new = updates.groupBy("i", "j").agg(F.max_by("v", "seq").alias("u"))
    return a.join(new, ["i", "j"], "left").select("i", "j", F.coalesce("u", "v").alias("v"))


def to_csr(a: DataFrame) -> DataFrame:
    """Position, row, column and value in row order; the entries before a row are summed by stretches of rows."""
    from krylith.operators.storage import offsets

    ptr = offsets(a.groupBy("i").agg(F.count("*").alias("n")), "i", "n").select("i", "ptr")
    return a.join(ptr, "i").select((F.col("ptr") + F.row_number().over(Window.partitionBy("i").orderBy("j")) - 1).alias("pos"), "i", "j", "v")


def to_csc(a: DataFrame) -> DataFrame:
    return to_csr(transpose(a)).select("pos", F.col("j").alias("i"), F.col("i").alias("j"), "v")


def to_dia(a: DataFrame) -> DataFrame:
    return a.select((F.col("j") - F.col("i")).alias("offset"), "i", "v")


def to_ell(a: DataFrame) -> DataFrame:
    """Each entry's slot within its row."""
    return a.select("i", (F.row_number().over(Window.partitionBy("i").orderBy("j")) - 1).alias("slot"), "j", "v")


def to_msr(a: DataFrame) -> DataFrame:
    """Diagonal entries first (part 0), then the others (part 1)."""
    return a.select(F.when(F.col("i") == F.col("j"), 0).otherwise(1).alias("part"), "i", "j", "v")


def to_jad(a: DataFrame) -> DataFrame:
    """ELL with rows in the order of falling size: perm is a row's place."""
    from krylith.operators.storage import ranks

    perm = ranks(a.groupBy("i").agg(F.count("*").alias("n")), -F.col("n"), "perm").select("i", "perm")
    return to_ell(a).join(perm, "i").select("perm", "slot", "i", "j", "v")


def to_bsr(a: DataFrame, rows: int = 2, cols: int = 2) -> DataFrame:
    block = lambda c, n: F.floor(F.col(c) / n).cast("long")
    return a.select(block("i", rows).alias("bi"), block("j", cols).alias("bj"), (F.col("i") % rows).alias("r"), (F.col("j") % cols).alias("c"), "v")


def axpyz(alpha: float, a: DataFrame, b: DataFrame) -> DataFrame:
    """alpha A + B as a matrix of its own."""
    return axpy(alpha, a, b)


def set_block(a: DataFrame, rows: list[int], cols: list[int], values: list[list[float]], add: bool = True) -> DataFrame:
    """Adds a dense block of values at rows x cols, or puts it there."""
    new = a.sparkSession.createDataFrame([(i, j, float(values[r][c])) for r, i in enumerate(rows) for c, j in enumerate(cols)], "i long, j long, v double")
    if add:
        return axpy(1.0, new, a)
    return a.join(new.select("i", "j"), ["i", "j"], "left_anti").select("i", "j", "v").unionByName(new)


def nnz(a: DataFrame) -> DataFrame:
    return a.agg(F.count("*").alias("value"))


def shape(a: DataFrame) -> DataFrame:
    return a.agg((F.max("i") + 1).alias("n_rows"), (F.max("j") + 1).alias("n_cols"))


def outside(entries: DataFrame, n: int) -> DataFrame:
    """Staged entries whose place is not in an n x n matrix."""
    return entries.where((F.col("i") < 0) | (F.col("i") >= n) | (F.col("j") < 0) | (F.col("j") >= n) | F.col("i").isNull() | F.col("j").isNull())


def diagonal_blocks(a: DataFrame, size: int) -> DataFrame:
    """The diagonal blocks of size rows as (block, r, c, v)."""
    block = lambda c: F.floor(F.col(c) / size).cast("long")
    return a.where(block("i") == block("j")).select(block("i").alias("block"), (F.col("i") % size).alias("r"), (F.col("j") % size).alias("c"), "v")


def blocks_matvec(d: DataFrame, size: int, x: DataFrame, adjoint: bool = False) -> DataFrame:
    """Product of a block diagonal, or of its transpose, with a vector."""
    a = d.select((F.col("block") * size + F.col("r")).alias("i"), (F.col("block") * size + F.col("c")).alias("j"), "v")
    return matvech(a, x) if adjoint else matvec(a, x)


def blocks_scale(alpha: float, d: DataFrame) -> DataFrame:
    return d.select("block", "r", "c", (alpha * F.col("v")).alias("v"))


def blocks_inverse(d: DataFrame, size: int) -> DataFrame:
    """Inverses of the blocks; one row of numpy work for each."""
    import numpy as np
    import pandas as pd

    def run(key, rows):
        dense = np.zeros((size, size))
        np.add.at(dense, (rows["r"].to_numpy(), rows["c"].to_numpy()), rows["v"].to_numpy())
        have = np.unique(np.r_[rows["r"], rows["c"]])  # the last block may be smaller
        found = np.linalg.inv(dense[np.ix_(have, have)])
        r, c = np.meshgrid(have, have, indexing="ij")
        return pd.DataFrame({"block": key[0], "r": r.ravel(), "c": c.ravel(), "v": found.ravel()})

    return d.groupBy("block").applyInPandas(run, "block long, r long, c long, v double")
