"""Harwell-Boeing files of square unsymmetric assembled real matrices (RUA) in fixed-width columns.

The format is one stream of numbers by columns, so a file is read in one task and becomes rows; the
order of its header cards says how many lines of each kind follow.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def widths(form: str) -> tuple[int, int]:
    """Numbers a line and characters a number of a Fortran format such as (10I8) or (1P5D16.8)."""
    found = re.search(r"(\d*)[IEDFG](\d+)", re.sub(r"[\s()]|\d+P,?", "", form.upper()))
    if not found:
        raise ValueError(f"unknown format {form}")
    return int(found[1] or 1), int(found[2])


def fields(lines: list[str], form: str, count: int) -> list[str]:
    per, width = widths(form)
    got = [line[k * width : (k + 1) * width].strip() for line in lines for k in range(per)]
    got = [g for g in got if g][:count]
    if len(got) != count:
        raise ValueError(f"{len(got)} numbers for {count}")
    return got


def real(text: str) -> float:
    text = text.upper().replace("D", "E")
    return float(re.sub(r"(?<=[0-9.])([+-]\d+)$", r"E\1", text) if "E" not in text else text)


def parse(text: str) -> dict:
    """order, rows (i, j, v), and vectors b, guess and exact (lists or None) of a file's text."""
    lines = text.splitlines()
    if len(lines) < 4:
        raise ValueError("no header")
    _, pointers, indices, numbers, right = ([int(x or 0) for x in (lines[1][k * 14 : (k + 1) * 14].strip() for k in range(5))] + [0] * 5)[:5]
    kind = lines[2][:3].upper()
    n_rows, n_cols, nnz = (int(lines[2][14 + 14 * k : 28 + 14 * k]) for k in range(3))
    if kind != "RUA" or n_rows != n_cols:
        raise ValueError(f"only square RUA matrices: {kind} {n_rows} x {n_cols}")
    forms = [lines[3][0:16], lines[3][16:32], lines[3][32:52], lines[3][52:72]]
    at = 5 if right else 4
    take = lambda n, form, count: fields(lines[at : at + n], form, count)
    ptr = [int(x) for x in take(pointers, forms[0], n_cols + 1)]
    at += pointers
    rows = [int(x) for x in take(indices, forms[1], nnz)]
    at += indices
    vals = [real(x) for x in take(numbers, forms[2], nnz)]
    at += numbers
    out: dict = {"order": n_rows, "rows": [(rows[k] - 1, j, vals[k]) for j in range(n_cols) for k in range(ptr[j] - 1, ptr[j + 1] - 1)], "b": None, "guess": None, "exact": None}
    if right:
        marks = lines[4][:3].upper().ljust(3)
        if marks[0] != "F":
            raise ValueError("right-hand sides must be full")
        names = ["b"] + ["guess"] * (marks[1] == "G") + ["exact"] * (marks[2] == "X")
        got = [real(x) for x in take(right, forms[3], n_rows * len(names))]
        for k, name in enumerate(names):
            out[name] = got[k * n_rows : (k + 1) * n_rows]
    return out


def read(spark: SparkSession, path: str) -> tuple[DataFrame, int, DataFrame | None, DataFrame | None]:
    """(matrix, order, b, x) with x the exact solution, or else the guess."""
    head = spark.read.text(path, wholetext=True)
    shape = "order long, rows array<struct<i:long,j:long,v:double>>, b array<double>, guess array<double>, exact array<double>"

    def run(frames):
        for frame in frames:
            for text in frame["value"]:
                import pandas as pd

                yield pd.DataFrame([parse(text)])

    found = head.mapInPandas(run, shape).cache()
    n, has_b, has_x = found.select("order", F.col("b").isNotNull(), F.coalesce("exact", "guess").isNotNull()).first()
    vector = lambda c: found.select(F.posexplode(c).alias("i", "v")).select(F.col("i").cast("long").alias("i"), "v")
    return found.select(F.explode("rows").alias("e")).select("e.i", "e.j", "e.v"), n, vector(F.col("b")) if has_b else None, vector(F.coalesce("exact", "guess")) if has_x else None


def text(rows: list[tuple[int, int, float]], n: int, b: list[float] | None = None, title: str = "matrix", key: str = "KEY") -> str:
    """The file of a matrix given by entries, with a full right-hand side if there is one."""
    rows = sorted(rows, key=lambda e: (e[1], e[0]))
    count = [0] * (n + 1)
    for _, j, _ in rows:
        count[j + 1] += 1
    ptr, total = [], 1
    for c in count:
        total += c
        ptr.append(total)

    def block(values: list, per: int, form: str) -> list[str]:
        return ["".join(form % v for v in values[k : k + per]) for k in range(0, len(values), per)]

    parts = [block(ptr, 8, "%10d"), block([i + 1 for i, _, _ in rows], 8, "%10d"), block([v for _, _, v in rows], 3, "%26.16E"), block(b or [], 3, "%26.16E")]
    sizes = [sum(map(len, parts)), *map(len, parts)]
    head = [f"{title:<72.72}{key:<8.8}", "".join(f"{s:14d}" for s in sizes), f"{'RUA':<14}{n:14d}{n:14d}{len(rows):14d}{0:14d}", f"{'(8I10)':<16}{'(8I10)':<16}{'(3E26.16)':<20}{'(3E26.16)':<20}"]
    if b:
        head.append(f"{'F':<14}{1:14d}{0:14d}")
    return "\n".join([*head, *(line for part in parts for line in part)]) + "\n"
