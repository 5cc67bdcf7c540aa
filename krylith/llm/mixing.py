"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions.

Targets: sources in code-point order (null last) have weights in turn; they share a multiple of all
sizes, and no source gets more than `most` times its own. A source's complete epochs take each of its
documents; the rest of its target takes documents in the order of exponential keys scaled by
quality weight. The prefix sums of that order go through buckets of the key: sizes are summed by
bucket, then over buckets, and only inside a bucket over documents, so no task sorts a whole source.
Keys of weight w are exponential with rate w; buckets are even steps of the mixture of these
distributions, by the number of documents of each weight, so they hold about as many documents each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from krylith.llm.tables import Scratch

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 8192


def targets(sizes: DataFrame, weights: tuple[float, ...], total_share: float, most: float) -> DataFrame:
    """sizes: source, source_size. Adds target: the level to which all weights rise, sources that are full aside."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(turn, F.lit(len(weights))) + 1).cast("int")))
    listed = listed.withColumn("cap", F.col("source_size") * float(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = lambda c: F.sum(c).over(by_ratio) - F.col(c)
    level = (F.sum("source_size").over(everything) * total_share - before("cap")) / (F.sum("weight").over(everything) - before("weight"))
    listed = listed.withColumn("level", level).withColumn("turn", F.row_number().over(by_ratio))
    reached = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct("turn", "level"))).over(everything)["level"]
    return listed.select("source", "source_size", F.least("cap", F.coalesce(reached * F.col("weight"), F.col("cap"))).alias("target"))


def steps(sized: DataFrame) -> Column:
    """The share of all keys that lie below a row's key: a mixture over weights, in classes of half a power of two (at most 129)."""
    power = F.greatest(F.lit(-64), F.least(F.lit(64), F.round(2 * F.log2("weight")))).cast("int")
    found = sized.groupBy(power.alias("power")).agg(F.count("*").alias("n")).collect()
    total = max(sum(r["n"] for r in found), 1)
    share = F.lit(0.0)
    for r in sorted(found, key=lambda r: r["power"]):
        share = share + F.lit(r["n"] / total) * (1 - F.exp(F.lit(-(2.0 ** (r["power"] / 2))) * F.col("key")))
    return share


def md5_draw(seed: int = 42, id_col: str = "doc_id") -> Column:
    """A draw that other engines find too: 52 bits of the MD5 of seed and id."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / float(1 << 52)


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[float, ...] = (5, 2, 1), total_share: float = 1.5, most: float = 2.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False, draw: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, epochs, taken; with carry also the row as a struct, carried.

    quality: id and weight of documents, one row for an id; documents without a positive weight have 1. Null texts have size 0. A document is taken `epochs` times, and once more if the middle of
    its place in the prefix sums lies in the rest of the target. Equal keys go by id, then size;
    repeated rows are documents of their own. draw: a number of docs between 0 and 1, both excluded, that gives a row's key; without it, keys depend on seed and id alone, so reruns agree. One
    task ranks the sources, a row for each. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession)
    unit = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52) if draw is None else draw
    extra = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("carried")] if carry else []
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), (-F.log(unit)).alias("key"), *extra)
    if quality is not None:
        marks = quality.toDF("doc_id", "weight").where("doc_id is not null and weight > 0")
        sized = sized.join(marks, "doc_id", "left").withColumn("weight", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)))
    else:
        sized = sized.withColumn("weight", F.lit(1.0))
    sized = scratch.save(sized.withColumn("key", F.col("key") / F.col("weight")))
    sized = sized.withColumn("bucket", F.floor(steps(sized) * BUCKETS).cast("int")).drop("weight")
    aimed = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total_share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0)).cast("long")
    aimed = scratch.save(aimed.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size")
    placed = sums.withColumn("before", before).join(aimed.withColumnRenamed("source", "aim"), F.col("source").eqNullSafe(F.col("aim"))).drop("aim")
    placed = scratch.save(placed.select(F.col("source").alias("at_source"), F.col("bucket").alias("at_bucket"), "before", "source_size", "target", "epochs", "rest"))
    rows = sized.join(placed, F.col("source").eqNullSafe(F.col("at_source")) & (F.col("bucket") == F.col("at_bucket")))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("size").over(inside) - F.col("size") / 2
    taken = (F.col("size") * (F.col("epochs") + F.col("more"))).alias("taken")
    return rows.withColumn("more", (middle <= F.col("rest")).cast("long")).select("doc_id", "source", "size", "source_size", "target", "epochs", taken, *(["carried"] if carry else []))
