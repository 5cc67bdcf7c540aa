"""A training corpus from raw documents: the stages, each of one operator, and their run.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. In all of
them: a row without an id is judged by its text, rows without an id and with equal texts alike; a null
or empty text is a document without words; repeated rows are documents like others unless a stage
says otherwise; an empty table gives an empty table; columns may have any names beside doc_id, text
and source, and those of the documents come back, but for the last stage, which adds its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from krylith.llm.decontaminate import decontaminate
from krylith.llm.mixing import mix
from krylith.llm.near_duplicates import near_duplicates
from krylith.llm.quality_rules import quality_rules
from krylith.llm.queries import quality_weights
from krylith.llm.substring_dedup import substring_dedup
from krylith.llm.tables import Scratch

#: The stages have no SQL form (tokenisers, signatures, sampling keys); tests/llm/test_pipeline.py compares each with brute force.
ORACLE_SQL = None


def free(docs: DataFrame, name: str) -> str:
    """A column name like this that docs doesn't have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def key() -> Column:
    """The id of a document; without one, a number beyond 2**62 that its text gives."""
    return F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), 2) + F.lit(1 << 62))


def without(docs: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """docs, keyed by column name, without the keys in gone (one column); the key goes too."""
    listed = gone.toDF(name).distinct()
    return docs.join(listed, name, "left_anti").drop(name)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A text of under ten words goes, so null and empty ones do; rows that share an id are judged each, and go together if one fails."""
    name = free(docs, "_key")
    keyed = docs.withColumn(name, key())
    lang = "lang" if "lang" in docs.columns else None
    return without(keyed, name, quality_rules(keyed, id_col=name, lang_col=lang).where("not kept").select("doc_id"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by similarities of 0.8 or more; those without words stay.

    32 bands of 5 lose a link of 0.8 with chance (1 - 0.8**5)**32 = 3.0e-6. Rows with equal id and text are
    one document, and so are rows without an id and with equal texts; a document with an id stays before one without.
    """
    name = free(docs, "_key")
    keyed = docs.withColumn(name, key())
    found = near_duplicates(keyed, least=80, of=100, count=32, rows_in_band=5, id_col=name)
    gone = found.where("not kept").select("doc_id")
    # rows of one key are one document: most keys have one row, so only those that repeat are grouped
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(name))
    once = keyed.join(repeated, name, "left_anti")
    again = keyed.join(repeated, name, "left_semi").dropDuplicates([name, "text"])
    return without(once.unionByName(again), name, gone)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated windows; those that lose all their words go. n_chars, if there, follows the text. Each row counts as a document."""
    cut = substring_dedup(docs, with_text=True, carry=True).where("n_removed = 0 or kept_text <> ''")
    columns = {c: F.col(f"carried.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return cut.select(*(columns[c].alias(c) for c in docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates; rows that share an id go together if one is contaminated."""
    name = free(docs, "_key")
    keyed = docs.withColumn(name, key())
    return without(keyed, name, decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=name).select("doc_id"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix with their columns, and size, source_size, target, epochs and taken (named with a line behind if documents have the name). Documents without words aren't in it."""
    weights = quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mixed = mix(docs, weights, carry=True).where("taken > 0")
    own = [F.col(f"carried.`{c}`").alias(c) for c in docs.columns]
    return mixed.select(*own, *(F.col(c).alias(free(docs, c)) for c in ("size", "source_size", "target", "epochs", "taken")))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again for the next, and then removed."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        old, docs = docs, scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(old)
    return STAGES[-1][1](spark, docs, sf_dir)
