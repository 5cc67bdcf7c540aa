"""Storage formats as DataFrames of arrays, the way back, and products with a vector for each.

pack(a, n, name) gives the format's table, unpack gives (i, j, v) again, spmv multiplies. No format
gathers the matrix: a row of a table holds a matrix row, a column, a block or a stretch of a
diagonal, so its size is bounded by a row's entries or by STRETCH.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 4096
FORMATS = ("coo", "csr", "csc", "msr", "dia", "ell", "jad", "bsr", "bsc", "vbr", "dns")


def offsets(sizes: DataFrame, key: str, size: str) -> DataFrame:
    """Adds ptr, the sum of sizes at smaller keys: by stretches of keys, then inside each, so no task holds all."""
    placed = sizes.withColumn("stretch", F.floor(F.col(key) / STRETCH))
    sums = placed.groupBy("stretch").agg(F.sum(size).alias("total"))
    before = sums.select("stretch", (F.sum("total").over(Window.orderBy("stretch")) - F.col("total")).alias("before"))  # one row for STRETCH keys
    inside = F.sum(size).over(Window.partitionBy("stretch").orderBy(key)) - F.col(size)
    return placed.withColumn("inside", inside).join(before, "stretch").withColumn("ptr", F.col("before") + F.col("inside")).drop("stretch", "before", "inside")


def ranks(keys: DataFrame, key: Column, name: str) -> DataFrame:
    """Adds the place of each row in the order of key, a column of longs: by key, then within one; ties by i."""
    keyed = keys.withColumn("_key", key)
    per = offsets(keyed.groupBy("_key").agg(F.count("*").alias("_n")), "_key", "_n").select("_key", "ptr")
    parts = keyed.withColumn("_part", F.floor(F.col("i") / STRETCH))
    counts = parts.groupBy("_key", "_part").agg(F.count("*").alias("_n"))
    before = counts.select("_key", "_part", (F.sum("_n").over(Window.partitionBy("_key").orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_key", "_part").orderBy("i")) - 1
    ranked = parts.withColumn("_inside", inside).join(before, ["_key", "_part"]).join(per, "_key")
    return ranked.withColumn(name, F.col("ptr") + F.col("_before") + F.col("_inside")).drop("_key", "_part", "_before", "_inside", "ptr")


def lines(a: DataFrame, key: str, other: str) -> DataFrame:
    """One row for each key: idx (the other index, ascending) and val."""
    e = F.array_sort(F.collect_list(F.struct(F.col(other).alias("x"), F.col("v"))))
    return a.groupBy(key).agg(e.alias("e")).select(key, F.col("e.x").alias("idx"), F.col("e.v").alias("val"))


def long_form(packed: DataFrame, key: str, other: str) -> DataFrame:
    zipped = F.arrays_zip(F.col("idx").alias("x"), F.col("val").alias("v"))
    return packed.select(key, F.explode(zipped).alias("e")).select(F.col(key), F.col("e.x").alias(other), F.col("e.v").alias("v"))


def edges(bounds: list[int], c: str) -> Column:
    """The block of an index under ascending block starts."""
    return (F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(c))) - 1).cast("long")


def filled(size: Column) -> Column:
    """The size values of a dense run, of column e: (at, v) in order, with zeros between them. A place held twice is an error."""
    gap = lambda x, k: x["at"] - F.coalesce(F.get(F.col("e.at"), k - 1), F.lit(-1))
    runs = F.flatten(F.transform("e", lambda x, k: F.concat(F.array_repeat(F.lit(0.0), gap(x, k) - 1), F.array(x["v"]))))
    rest = F.array_repeat(F.lit(0.0), size - 1 - F.element_at("e.at", -1))
    return F.when(F.array_min(F.transform("e", gap)) < 1, F.raise_error(F.lit("two entries at one place"))).otherwise(F.concat(runs, rest))


def dense_blocks(a: DataFrame, block: list[Column], r: Column, c: Column, rows: Column, cols: Column) -> DataFrame:
    """bi, bj, rows, cols and val: the block's entries by columns, zeros included."""
    cells = a.select(block[0].alias("bi"), block[1].alias("bj"), r.alias("r"), c.alias("c"), rows.cast("int").alias("rows"), cols.cast("int").alias("cols"), "v")
    e = F.array_sort(F.collect_list(F.struct((F.col("c") * F.col("rows") + F.col("r")).cast("int").alias("at"), "v")))
    found = cells.groupBy("bi", "bj", "rows", "cols").agg(e.alias("e"))
    return found.select("bi", "bj", "rows", "cols", filled(F.col("rows") * F.col("cols")).alias("val"))


def pack(a: DataFrame, n: int, name: str, rows: int = 2, cols: int = 2, bounds: list[int] | None = None) -> DataFrame:
    """rows, cols: block size of bsr and bsc; bounds: starts of vbr's blocks, by default every third index."""
    if name == "coo":
        return a.select("i", "j", "v")
    if name in ("csr", "csc"):
        key, other = ("i", "j") if name == "csr" else ("j", "i")
        packed = lines(a, key, other)
        ptr = offsets(packed.select(key, F.size("val").cast("long").alias("n")), key, "n").select(key, "ptr")
        return packed.join(ptr, key).select(key, "ptr", "idx", "val")
    if name == "msr":
        rest = lines(a.where("i <> j"), "i", "j")
        diagonal = a.where("i = j").select("i", F.col("v").alias("diag"))
        return diagonal.join(rest, "i", "full").select("i", "diag", F.coalesce("idx", F.array().cast("array<long>")).alias("idx"), F.coalesce("val", F.array().cast("array<double>")).alias("val"))
    if name == "dia":
        e = F.array_sort(F.collect_list(F.struct("i", "v")))
        runs = a.groupBy((F.col("j") - F.col("i")).alias("offset"), F.floor(F.col("i") / STRETCH).alias("stretch")).agg(e.alias("e"))
        return runs.select("offset", "stretch", F.col("e.i").alias("idx"), F.col("e.v").alias("val"))
    if name == "ell":
        packed = lines(a, "i", "j")
        most = packed.agg(F.max(F.size("val")).alias("most"))  # one row
        pad = lambda c, x: F.concat(F.col(c), F.array_repeat(x, F.col("most") - F.size("val")))
        return packed.join(F.broadcast(most)).select("i", pad("idx", F.col("i")).alias("idx"), pad("val", F.lit(0.0)).alias("val"))
    if name == "jad":
        packed = lines(a, "i", "j")
        placed = ranks(packed, -F.size("val").cast("long"), "perm")
        cells = placed.select("perm", "i", F.posexplode(F.arrays_zip(F.col("idx").alias("j"), F.col("val").alias("v"))).alias("slot", "e"))
        e = F.array_sort(F.collect_list(F.struct("perm", "i", "e.j", "e.v")))
        runs = cells.groupBy("slot", F.floor(F.col("perm") / STRETCH).alias("stretch")).agg(e.alias("e"))
        return runs.select("slot", "stretch", F.col("e.perm").alias("perm"), F.col("e.i").alias("row"), F.col("e.j").alias("idx"), F.col("e.v").alias("val"))
    if name in ("bsr", "bsc"):
        block = [F.floor(F.col(c) / m).cast("long") for c, m in (("i", rows), ("j", cols))]
        blocks = dense_blocks(a, block, F.col("i") % rows, F.col("j") % cols, F.lit(rows), F.lit(cols))
        key, other = ("bi", "bj") if name == "bsr" else ("bj", "bi")
        e = F.array_sort(F.collect_list(F.struct(F.col(other).alias("x"), F.col("val").alias("v"))))
        return blocks.groupBy(key).agg(e.alias("e")).select(key, F.lit(rows).alias("rows"), F.lit(cols).alias("cols"), F.col("e.x").alias("idx"), F.col("e.v").alias("val"))
    if name == "vbr":
        if bounds is None:
            bi, bj = (F.floor(F.col(c) / 3).cast("long") for c in "ij")
            start, size = lambda b: b * 3, lambda b: F.least(F.lit(3), n - b * 3)
        else:
            starts, sizes = F.array(*[F.lit(b) for b in bounds]), F.array(*[F.lit(y - x) for x, y in zip(bounds, [*bounds[1:], n])])
            bi, bj, start, size = edges(bounds, "i"), edges(bounds, "j"), lambda b: starts[b], lambda b: sizes[b]
        found = dense_blocks(a, [bi, bj], F.col("i") - start(bi), F.col("j") - start(bj), size(bi), size(bj))
        return found.select("bi", "bj", start(F.col("bi")).cast("long").alias("row"), start(F.col("bj")).cast("long").alias("col"), "rows", "cols", "val")
    if name == "dns":
        e = F.array_sort(F.collect_list(F.struct(F.col("j").cast("int").alias("at"), "v")))
        return a.groupBy("i").agg(e.alias("e")).select("i", filled(F.lit(n)).alias("val"))
    raise ValueError(f"unknown format {name}")


def unpack(packed: DataFrame, name: str) -> DataFrame:
    """(i, j, v) of a packed table; zeros that only fill up are left out, and so are stored zeros of the filled formats."""
    if name == "coo":
        return packed.select("i", "j", "v")
    if name == "csr":
        return long_form(packed, "i", "j")
    if name == "csc":
        return long_form(packed, "j", "i").select("i", "j", "v")
    if name == "msr":
        return long_form(packed, "i", "j").unionByName(packed.where("diag is not null").select("i", F.col("i").alias("j"), F.col("diag").alias("v")))
    if name == "dia":
        cells = packed.select("offset", F.explode(F.arrays_zip(F.col("idx").alias("i"), F.col("val").alias("v"))).alias("e"))
        return cells.select("e.i", (F.col("e.i") + F.col("offset")).alias("j"), "e.v")
    if name == "ell":
        return long_form(packed, "i", "j").where("v <> 0")
    if name == "jad":
        return packed.select(F.explode(F.arrays_zip(F.col("row").alias("i"), F.col("idx").alias("j"), F.col("val").alias("v"))).alias("e")).select("e.i", "e.j", "e.v")
    if name in ("bsr", "bsc"):
        key, other = ("bi", "bj") if name == "bsr" else ("bj", "bi")
        blocks = packed.select(key, "rows", "cols", F.explode(F.arrays_zip(F.col("idx").alias("x"), F.col("val").alias("v"))).alias("e")).select(key, F.col("e.x").alias(other), "rows", "cols", F.col("e.v").alias("val"))
        packed = blocks.withColumns({"row": F.col("bi") * F.col("rows"), "col": F.col("bj") * F.col("cols")})
    if name in ("bsr", "bsc", "vbr"):
        cells = packed.select("row", "col", "rows", F.posexplode("val").alias("at", "v")).where("v <> 0")
        return cells.select((F.col("row") + F.col("at") % F.col("rows")).alias("i"), (F.col("col") + F.floor(F.col("at") / F.col("rows"))).alias("j"), "v")
    if name == "dns":
        return packed.select("i", F.posexplode("val").alias("j", "v")).where("v <> 0").select("i", F.col("j").cast("long").alias("j"), "v")
    raise ValueError(f"unknown format {name}")


def convert(packed: DataFrame, n: int, old: str, new: str, **given) -> DataFrame:
    return pack(unpack(packed, old), n, new, **given)


def spmv(packed: DataFrame, name: str, x: DataFrame) -> DataFrame:
    """A x from a packed table; csc multiplies whole columns, so it joins once for a column and not for an entry."""
    right = x.select(F.col("i").alias("j"), F.col("v").alias("xv"))
    if name == "csc":
        scaled = packed.join(right, "j").select(F.explode(F.arrays_zip(F.col("idx").alias("i"), F.transform("val", lambda v: v * F.col("xv")).alias("v"))).alias("e"))
        return scaled.select("e.i", "e.v").groupBy("i").agg(F.sum("v").alias("v"))
    return unpack(packed, name).join(right, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("xv")).alias("v"))
