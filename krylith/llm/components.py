"""Connected components of a graph of any size: union-find inside partitions, then star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from krylith.llm.tables import Scratch


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's links; gives a link from each node to its smallest here."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while (up := parent[x]) != top:
            parent[x], x = top, up
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    found = [(x, root(x)) for x in parent]
    found = [(x, r) for x, r in found if x != r]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], ["u", "v"])


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links: u, v. One row (node, component) for each node that is not the smallest of its component.

    Alternates large-star and small-star steps until the links no longer change; the number of
    rounds is logarithmic in the longest path. A node with very many links is summed before the
    shuffle, and its join can be split.
    """
    now = scratch.save(links.select("u", "v").where("u <> v").mapInArrow(forest, "u long, v long").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        old, now = now, scratch.save(small.where("u <> v").distinct())
        scratch.drop(old)
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            return now.toDF("node", "component")
        mark = tuple(row)
