"""Vectors as DataFrames (i, v): element-wise maps, updates and reductions, all planned by Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def both(x: DataFrame, y: DataFrame, value: Column) -> DataFrame:
    """value over x.v (xv) and y.v (yv) at each index."""
    return x.select("i", F.col("v").alias("xv")).join(y.select("i", F.col("v").alias("yv")), "i").select("i", value.alias("v"))


def each(x: DataFrame, value: Column) -> DataFrame:
    return x.select("i", value.alias("v"))


def ieee(x: Column, y: Column) -> Column:
    """x / y with the infinities and NaN of floating point in place of null or an error."""
    sign = F.when(x == 0, F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(y == 0, sign).otherwise(F.try_divide(x, y))


V, X, Y = F.col, lambda: F.col("xv"), lambda: F.col("yv")


def axpy(a: float, x: DataFrame, y: DataFrame) -> DataFrame:
    return both(x, y, a * X() + Y())


def xpay(x: DataFrame, a: float, y: DataFrame) -> DataFrame:
    return both(x, y, X() + a * Y())


def pmul(x: DataFrame, y: DataFrame) -> DataFrame:
    return both(x, y, X() * Y())


def pdiv(x: DataFrame, y: DataFrame) -> DataFrame:
    """IEEE quotients: infinite at y = 0, and no number at 0 / 0."""
    return both(x, y, ieee(X(), Y()))


def scale(a: float, x: DataFrame) -> DataFrame:
    return each(x, a * F.col("v"))


def shift(sigma: float, x: DataFrame) -> DataFrame:
    """x - sigma."""
    return each(x, F.col("v") - sigma)


def absolute(x: DataFrame) -> DataFrame:
    return each(x, F.abs("v"))


def reciprocal(x: DataFrame) -> DataFrame:
    """Infinite at 0."""
    return each(x, ieee(F.lit(1.0), F.col("v")))


def set_all(a: float, x: DataFrame) -> DataFrame:
    return each(x, F.lit(a))


def set_values(x: DataFrame, updates: DataFrame, add: bool) -> DataFrame:
    """updates: seq, i, v. Insert: the last by seq wins; add: all are added."""
    new = updates.groupBy("i").agg((F.sum("v") if add else F.max_by("v", "seq")).alias("u"))
    return x.join(new, "i", "left").select("i", (F.col("v") + F.coalesce("u", F.lit(0.0)) if add else F.coalesce("u", "v")).alias("v"))


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    return both(x, y, X() * Y()).agg(F.sum("v").alias("value"))


def nrm1(x: DataFrame) -> DataFrame:
    return x.agg(F.sum(F.abs("v")).alias("value"))


def nrm2(x: DataFrame) -> DataFrame:
    return x.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("value"))


def nrmi(x: DataFrame) -> DataFrame:
    return x.agg(F.coalesce(F.max(F.abs("v")), F.lit(0.0)).alias("value"))


def total(x: DataFrame) -> DataFrame:
    return x.agg(F.sum("v").alias("value"))


def copy(x: DataFrame) -> DataFrame:
    return x.select("i", "v")


def swap(x: DataFrame, y: DataFrame) -> tuple[DataFrame, DataFrame]:
    return copy(y), copy(x)


def conjugate(x: DataFrame) -> DataFrame:
    """Of (i, re, im); a real vector is its own."""
    return x.select("i", "re", (-F.col("im")).alias("im")) if "im" in x.columns else copy(x)


def complex_dot(x: DataFrame, y: DataFrame, conjugated: bool = True) -> DataFrame:
    """re and im of x^H y, or of x^T y: (i, re, im) each."""
    both = x.select("i", F.col("re").alias("a"), F.col("im").alias("b")).join(y.select("i", F.col("re").alias("c"), F.col("im").alias("d")), "i")
    sign = 1 if conjugated else -1
    return both.agg(F.sum(F.expr("a * c") + sign * F.expr("b * d")).alias("re"), F.sum(F.expr("a * d") - sign * F.expr("b * c")).alias("im"))


def nhdot(x: DataFrame, y: DataFrame) -> DataFrame:
    """x^T y of real vectors."""
    return dot(x, y)


def size(x: DataFrame) -> DataFrame:
    return x.agg((F.coalesce(F.max("i"), F.lit(-1)) + 1).cast("long").alias("value"))


def ranges(x: DataFrame, n: int, parts: int) -> DataFrame:
    """part, first, past and the number of stored values of each even share of the indices."""
    share = [n * k // parts for k in range(parts + 1)]
    bounds = x.sparkSession.createDataFrame([(k, share[k], share[k + 1]) for k in range(parts)], "part int, first long, past long")
    part = F.size(F.filter(F.array(*[F.lit(s) for s in share[:-1]]), lambda s: s <= F.col("i"))) - 1
    counts = x.groupBy(part.cast("int").alias("part")).agg(F.count("*").alias("n"))
    return bounds.join(counts, "part", "left").select("part", "first", "past", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def get_values(x: DataFrame, start: int, count: int) -> DataFrame:
    return x.where((F.col("i") >= start) & (F.col("i") < start + count)).select("i", "v")


def get_value(x: DataFrame, i: int) -> DataFrame:
    return get_values(x, i, 1)


def set_value(x: DataFrame, i: int, value: float, add: bool = False) -> DataFrame:
    return each(x, F.when(F.col("i") == i, (F.col("v") if add else F.lit(0.0)) + F.lit(float(value))).otherwise(F.col("v")))


def set_run(x: DataFrame, start: int, values: list[float], add: bool = False) -> DataFrame:
    """Sets or adds values at consecutive indices from start."""
    new = x.sparkSession.createDataFrame([(k, start + k, float(v)) for k, v in enumerate(values)], "seq long, i long, v double")
    return set_values(x, new, add)


def scatter(x: DataFrame, parts: int) -> DataFrame:
    """The values dealt to even shares of indices: part, first and val, each share one row."""
    n = F.max("i") + 1
    total = x.agg(n.alias("n"))
    part = F.floor(F.col("i") * parts / F.col("n")).cast("int")
    return x.join(F.broadcast(total)).groupBy(part.alias("part")).agg(F.min("i").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("val"))


def gather(parts: DataFrame) -> DataFrame:
    """(i, v) of scattered parts."""
    return parts.select("first", F.posexplode("val").alias("at", "v")).select((F.col("first") + F.col("at")).alias("i"), "v")
