"""Test matrices from ranges: stencils of Laplacians and a Toeplitz band."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stencil(spark: SparkSession, shape: tuple[int, ...], neighbours: list[tuple[int, ...]], centre: float) -> DataFrame:
    """-1 to each neighbour inside the grid, centre on the diagonal."""
    n = 1
    for m in shape:
        n *= m
    points, rest = spark.range(n).withColumnRenamed("id", "i"), F.col("i")
    axes = []
    for m in reversed(shape):
        axes.insert(0, rest % m)
        rest = F.floor(rest / m)
    entries = []
    for offset in neighbours:
        j, inside = F.lit(0), F.lit(True)
        for m, axis, d in zip(shape, axes, offset):
            inside &= (axis + d >= 0) & (axis + d < m)
            j = j * m + axis + d
        entries.append(F.when(inside, F.struct(j.cast("long").alias("j"), F.lit(-1.0).alias("v"))))
    entries.append(F.struct(F.col("i").alias("j"), F.lit(float(centre)).alias("v")))
    return points.select("i", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("i", "e.j", "e.v")


def unit_neighbours(d: int) -> list[tuple[int, ...]]:
    return [tuple(s if k == a else 0 for k in range(d)) for a in range(d) for s in (-1, 1)]


def laplace(spark: SparkSession, *shape: int) -> DataFrame:
    """The 3-, 5- or 7-point Laplacian on a grid."""
    return stencil(spark, shape, unit_neighbours(len(shape)), 2 * len(shape))


def toeplitz(spark: SparkSession, n: int, gamma: float) -> DataFrame:
    """gamma at i-2, 1 at i+1, 2 on the diagonal."""
    rows = spark.range(n).withColumnRenamed("id", "i")
    e = F.array(F.struct((F.col("i") - 2).alias("j"), F.lit(float(gamma)).alias("v")), F.struct((F.col("i") + 1).alias("j"), F.lit(1.0).alias("v")), F.struct(F.col("i").alias("j"), F.lit(2.0).alias("v")))
    return rows.select("i", F.explode(e).alias("e")).select("i", "e.j", "e.v").where(f"j >= 0 and j < {n}")
