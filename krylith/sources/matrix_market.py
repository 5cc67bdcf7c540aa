"""Extended Matrix Market text files: matrices with right-hand side and solution behind them, vectors, and plain vectors.

Lines are numbered by their place in the file, whatever splits Spark reads it in: a split's lines
are counted, and the counts of the splits before it added. The head is found by number, and the
numbers of entries are compared with the size line.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BANNER = "%%matrixmarket"


@dataclass
class Lines:
    """Lines of one file, or of the part files of a folder in order of name.

    frame: line (from 0) and value of each. count: of all; skipped: of comments and empty ones; first: number of the
    first other one, None without one; size: its text; banner: the text of line 0.
    """

    frame: DataFrame
    count: int
    skipped: int
    first: int | None
    size: str
    banner: list[str]


SKIP = "startswith(value, '%') OR value = ''"


def numbered(spark: SparkSession, path: str) -> Lines:
    """A split's lines follow each other in one task, so a line's number is told by its id, the split's first id and the lines of the splits before; nothing is sorted."""
    where = ["_metadata.file_path", "_metadata.file_block_start"]
    lines = spark.read.text(path).select(*(F.col(c).alias(k) for c, k in zip(where, "fs")), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("value"))
    skip = F.expr(SKIP)
    counts = lines.groupBy("f", "s").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    shift = F.sum("n").over(Window.orderBy("f", "s")) - F.col("n") - F.col("low")  # one row for a split
    placed = counts.select(F.shiftright("low", 33).alias("task"), "low", (F.col("low") + F.col("n")).alias("high"), shift.alias("shift"))
    found = (F.shiftright("at", 33) == F.col("task")) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))
    frame = lines.select("at", "value").join(F.broadcast(placed), found).select((F.col("at") + F.col("shift")).alias("line"), "value")
    # a row for each split
    splits = lines.groupBy("f", "s").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.sum(skip.cast("int")).alias("skipped"), F.min(F.when(~skip, F.col("at"))).alias("first")).orderBy("f", "s").collect()
    before, first = 0, None
    for r in splits:
        if r["first"] is not None:
            first = before + r["first"] - r["low"]
            break
        before += r["n"]
    wanted = {0, first} - {None} if splits else set()
    head = {}
    if wanted and (first or 0) < 1000:  # the first lines of the first file, without a look at the others
        name = unquote(splits[0]["f"])
        if not set(name) & set("*?[]{}\\"):
            top = spark.read.text(name).select("_metadata.file_block_start", F.trim("value").alias("value")).where("file_block_start = 0").head((first or 0) + 1)
            head = {k: top[k]["value"] for k in wanted if k < min(len(top), splits[0]["n"])}
    if wanted - set(head):
        head = {r["line"]: r["value"] for r in frame.where(F.col("line").isin(*wanted)).collect()}
    return Lines(frame, sum(r["n"] for r in splits), sum(r["skipped"] for r in splits), first, head.get(first, ""), head.get(0, "").lower().split())


def body(lines: DataFrame, skip: Column, first: int, gaps: int | None = None) -> DataFrame:
    """Lines after number first that skip doesn't take, numbered on from 0 without them; gaps: how many it takes, if known."""
    kept = lines.where((F.col("line") > first) & ~skip)
    # lines that are skipped amid others are few: each line's number falls by those before it
    skipped = lines.where((F.col("line") > first) & skip).select(F.col("line").alias("gap"))
    if not gaps if gaps is not None else skipped.isEmpty():
        return kept.select((F.col("line") - first - 1).alias("line"), "value")
    both = kept.select("line", "value", F.lit(0).alias("g")).unionByName(skipped.select(F.col("gap").alias("line"), F.lit(None).cast("string").alias("value"), F.lit(1).alias("g")))
    stretch = F.floor(F.col("line") / 65536)
    per = both.groupBy(stretch.alias("k")).agg(F.sum("g").alias("n"))
    before = per.select("k", (F.sum("n").over(Window.orderBy("k")) - F.col("n")).alias("b"))  # one row for a stretch of lines
    inside = F.sum("g").over(Window.partitionBy("k").orderBy("line"))
    counted = both.withColumn("k", stretch).withColumn("inside", inside).join(F.broadcast(before), "k")
    return counted.where("g = 0").select((F.col("line") - first - 1 - F.col("b") - F.col("inside")).alias("line"), "value")


def values(parts: Column, at: int, kind: str) -> list[Column]:
    """v, or re and im, from the fields of a line."""
    if kind == "complex":
        return [parts[at].cast("double").alias("re"), parts[at + 1].cast("double").alias("im")]
    return [(F.lit(1.0) if kind == "pattern" else parts[at].cast("double")).alias("v")]


def checked(have: int, want: int, what: str) -> None:
    if have != want:
        raise ValueError(f"{what}: {have} lines, the size line says {want}")


def after_head(lines: Lines) -> tuple[DataFrame, int]:
    """The lines behind the size line, comments and empty ones left out and numbered from 0, and their count."""
    if lines.first is None:
        raise ValueError("no size line")
    gaps = lines.skipped - lines.first  # all lines before the first other one are skipped
    return body(lines.frame, F.expr(SKIP), lines.first, gaps), lines.count - lines.first - 1 - gaps


def read(spark: SparkSession, path: str) -> tuple[DataFrame, int, DataFrame | None, DataFrame | None]:
    """(matrix, order, b, x) of a square coordinate or array file: real, integer, pattern or complex; general, symmetric, skew-symmetric or hermitian. Indices become 0-based."""
    lines = numbered(spark, path)
    if lines.first is None:
        raise ValueError("no size line")
    words = lines.banner
    if words[:2] != [BANNER, "matrix"] or len(words) < 5 or words[2] not in ("coordinate", "array") or words[3] not in ("real", "integer", "pattern", "complex") or words[4] not in ("general", "symmetric", "skew-symmetric", "hermitian"):
        raise ValueError(f"not a matrix file that can be read: {path}")
    _, _, shape, kind, symmetry = words[:5]
    sizes = [int(w) for w in lines.size.split()]
    if len(sizes) not in ((2,) if shape == "array" else (3, 5, 6)) or sizes[0] != sizes[1]:
        raise ValueError(f"bad size line: {lines.size}")
    n = sizes[0]
    rows, have = after_head(lines)
    rows = rows.withColumn("p", F.split("value", r"\s+"))
    p = F.col("p")
    if shape == "array":
        if symmetry != "general" or kind == "pattern":
            raise ValueError("array files are general and have values")
        checked(have, n * n, path)
        at = [(F.col("line") % n).alias("i"), F.floor(F.col("line") / n).cast("long").alias("j")]
        if kind != "complex":  # mostly a line is its one field, which takes no pattern to find
            alone = ~F.contains("value", F.lit(" ")) & ~F.contains("value", F.lit("\t"))
            return rows.select(*at, F.when(alone, F.col("value")).otherwise(p[0]).cast("double").alias("v")), n, None, None
        return rows.select(*at, *values(p, 0, kind)), n, None, None
    nnz, flags = sizes[2], [*sizes[3:5], 0, 0][:2]
    checked(have, nnz + n * sum(map(bool, flags)), path)
    entries = rows.where(F.col("line") < nnz).select((p[0].cast("long") - 1).alias("i"), (p[1].cast("long") - 1).alias("j"), *values(p, 2, kind))
    if symmetry != "general":
        sign = -1 if symmetry == "skew-symmetric" else 1
        turned = {c: F.col(c) * (sign if c != "im" or symmetry != "hermitian" else -1) for c in entries.columns[2:]}
        off = entries.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), *(v.alias(c) for c, v in turned.items()))
        entries = entries.unionByName(off)
    vectors = []
    for k, there in enumerate(flags):
        start = nnz + n * sum(map(bool, flags[:k]))
        vectors.append(rows.where((F.col("line") >= start) & (F.col("line") < start + n)).select((p[0].cast("long") - 1).alias("i"), *values(p, 1, kind)) if there else None)
    return entries, n, *vectors


def read_vector(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(i, v) or (i, re, im) and the length of a vector file: Matrix Market with a banner, else plain, one value a line or several."""
    lines = numbered(spark, path)
    words = lines.banner
    if words[:1] == [BANNER]:
        if words[1:3] not in (["vector", "coordinate"], ["vector", "array"]):
            raise ValueError(f"not a vector: {path}")
        rows, have = after_head(lines)
        n = int(lines.size.split()[0])
        p = F.split("value", r"\s+")
        if words[2] == "array":
            checked(have, n, path)
            return rows.select(F.col("line").alias("i"), *values(p, 0, words[3])), n
        return rows.select((p[0].cast("long") - 1).alias("i"), *values(p, 1, words[3])), n
    rows = body(lines.frame, F.col("value") == "", -1)
    cells = rows.select("line", F.posexplode(F.split("value", r"\s+")).alias("at", "t"))
    most = cells.agg(F.max("at")).first()[0] or 0
    n = cells.count()
    if most == 0:
        return cells.select(F.col("line").alias("i"), F.col("t").cast("double").alias("v")), n
    width = most + 1  # all lines but the last hold as many
    return cells.select((F.col("line") * width + F.col("at")).alias("i"), F.col("t").cast("double").alias("v")), n


def number(*columns: str | Column) -> Column:
    return F.concat_ws(" ", *(F.format_string("%.17e", F.col(c) if isinstance(c, str) else c) for c in columns))


def text(a: DataFrame, n: int, b: DataFrame | None = None, x: DataFrame | None = None) -> DataFrame:
    """The lines (part, i, j, value) of a file, to be put out in this order."""
    spark, nnz = a.sparkSession, a.count()
    fields = [c for c in a.columns if c in ("v", "re", "im")]
    kind = "real" if fields == ["v"] else "complex"
    size = f"{n} {n} {nnz}" + (f" {int(b is not None)} {int(x is not None)}" if b is not None or x is not None else "")
    lines = spark.createDataFrame([(0, 0, 0, f"%%MatrixMarket matrix coordinate {kind} general"), (1, 0, 0, size)], "part int, i long, j long, value string")
    lines = lines.unionByName(a.select(F.lit(2).alias("part"), "i", "j", F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, number(*fields)).alias("value")))
    for part, vector in ((3, b), (4, x)):
        if vector is not None:
            lines = lines.unionByName(vector.select(F.lit(part).alias("part"), "i", F.lit(0).cast("long").alias("j"), F.concat_ws(" ", F.col("i") + 1, number(*fields)).alias("value")))
    return lines


def array_text(a: DataFrame, n: int) -> DataFrame:
    """The lines of a dense matrix by columns, a row (part, i, j, value) for each column; places that aren't stored are 0."""
    return array_columns(a, n).select("part", "i", "j", column_text(n).alias("value"))


def array_columns(a: DataFrame, n: int) -> DataFrame:
    """part, i, j, value, and e: the entries of a column, which column_text makes lines of."""
    spark = a.sparkSession
    lines = spark.createDataFrame([(0, 0, 0, "%%MatrixMarket matrix array real general"), (1, 0, 0, f"{n} {n}")], "part int, i long, j long, value string")
    held = a.groupBy(F.col("j").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("i").cast("int").alias("at"), "v"))).alias("e"))
    columns = spark.range(n).join(held, "id", "left").select(F.lit(2).alias("part"), F.col("id").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(None).cast("string").alias("value"), "e")
    return lines.withColumn("e", F.lit(None).cast(columns.schema["e"].dataType)).unionByName(columns)


def column_text(n: int) -> Column:
    """The n lines of a column, of which runs of zeros are repeated; a head line as it is. A place held twice is an error."""
    gap = lambda x, k: x["at"] - F.coalesce(F.get(F.col("e.at"), k - 1), F.lit(-1))
    zeros = lambda m: F.repeat(F.lit("0\n"), m)
    runs = F.array_join(F.transform("e", lambda x, k: F.concat(zeros(gap(x, k) - 1), number(x["v"]), F.lit("\n"))), "")
    last = F.coalesce(F.element_at("e.at", -1), F.lit(-1))
    text = F.rtrim(F.concat(F.coalesce(runs, F.lit("")), zeros(n - 1 - last)), F.lit("\n"))
    twice = F.array_min(F.transform("e", gap)) < 1
    return F.when(F.col("part") < 2, F.col("value")).when(twice, F.raise_error(F.lit("two entries at one place"))).otherwise(text)


def vector_text(x: DataFrame, n: int, form: str = "mm") -> DataFrame:
    """The lines of a vector: form mm or plain."""
    lines = x.select(F.lit(2).alias("part"), "i", F.lit(0).cast("long").alias("j"), (F.concat_ws(" ", F.col("i") + 1, number("v")) if form == "mm" else number("v")).alias("value"))
    if form == "plain":
        return lines
    if form != "mm":
        raise ValueError(f"unknown form {form}")
    return x.sparkSession.createDataFrame([(0, 0, 0, "%%MatrixMarket vector coordinate real general"), (1, 0, 0, str(n))], "part int, i long, j long, value string").unionByName(lines)


def put(lines: DataFrame, path: str, value: str | Column = "value") -> None:
    """Part files in a folder whose names sort in the order of the lines: each task writes a range of them. value is made after the exchange."""
    value = F.col(value) if isinstance(value, str) else value
    lines.repartitionByRange("part", "i", "j").sortWithinPartitions("part", "i", "j").select(value.alias("value")).write.mode("overwrite").text(path)


def write_array(a: DataFrame, n: int, path: str) -> None:
    put(array_columns(a, n), path, column_text(n))


def write(a: DataFrame, n: int, path: str, b: DataFrame | None = None, x: DataFrame | None = None) -> None:
    put(text(a, n, b, x), path)


def write_vector(x: DataFrame, n: int, path: str, form: str = "mm") -> None:
    put(vector_text(x, n, form), path)


def write_history(spark: SparkSession, history: list[float], path: str) -> None:
    """The residual norms of a solve as a plain vector."""
    write_vector(spark.createDataFrame(list(enumerate(map(float, history))), "i long, v double"), len(history), path, "plain")
