"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, quantities with units, unit words and names become typed placeholders; punctuation and case
go. Windows of `width` template tokens of each document are hash-joined with those of the benchmark
items. Matches of one document and item on one diagonal (document position minus item position)
are one alignment; its slots must be consistent: a value of the item always stands for the same
value in the document. So a question with other numbers or names is caught, while texts that only
share a form are not. A document is contaminated by an item of which consistent alignments
cover at least `share` of the windows.

What templates can't tell apart is compared exactly: windows with more placeholders than words, and
items shorter than a window as a whole, match the same words, case and punctuation aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "\u0001"
#: Unit words (fixed values).
UNITS = (
    "mm cm km kg mg lb lbs oz ml mph kmh meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards "
    "gram grams kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres gallon gallons second seconds minute minutes hour hours "
    "dollar dollars euro euros cent cents percent degrees celsius fahrenheit watt watts volt volts joule joules"
).split()
SPACE = r"[\x20\x09-\x0D]"
SOLID = r"[^\x20\x09-\x0D]"
ODD = r"[^\p{L}\p{N}\x20\x09-\x0D\x01]"
NAME = rf"(?=\p{{Lu}})(?<=[^.!?\x20\x09-\x0D]{SPACE})(\p{{Lu}}\p{{Ll}}{SOLID}*)"
QUANTITY = rf"(?<!{SOLID})({ODD}*[0-9][^\p{{L}}\x20\x09-\x0D]*\p{{L}}{{1,4}}{ODD}*)(?!{SOLID})"
NUMBER = rf"(?<!{SOLID})({ODD}*[0-9][^\p{{L}}\x20\x09-\x0D]*)(?!{SOLID})"
UNIT = rf"(?i)(?<!{SOLID})((?:{'|'.join(UNITS)}){ODD}*)(?!{SOLID})"
#: So many windows of a benchmark may be broadcast (at some 50 bytes each); more are shuffled.
BROADCAST_ROWS = 2_000_000


def canonical(docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """name, values (tokens; placeholders carry their value), template (tokens; placeholders carry their type only) and plain (tokens without marks)."""
    text = F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(MARK), F.lit(""))
    marked = F.regexp_replace(text, NAME, f"{MARK}p$1")
    digits = F.regexp_replace(F.regexp_replace(F.col("marked"), QUANTITY, f"{MARK}u$1"), NUMBER, f"{MARK}n$1")
    values = F.regexp_replace(F.lower(F.regexp_replace(F.when(F.col("marked").rlike("[0-9]"), digits).otherwise(F.col("marked")), UNIT, f"{MARK}u$1")), ODD + "+", "")
    template = F.when(F.contains("line", F.lit(MARK)), F.regexp_replace("line", rf"{MARK}([npu]){SOLID}*", f"{MARK}$1")).otherwise(F.col("line"))
    words = lambda c: F.split(F.trim(F.regexp_replace(c, rf"{SPACE}+", " ")), " ")
    lines = docs.select(F.col(id_col).cast("long").alias(name), marked.alias("marked")).select(name, values.alias("line"))
    return lines.select(name, words(F.col("line")).alias("values"), words(template).alias("template"), words(F.regexp_replace("line", f"{MARK}[npu]", "")).alias("plain"))


def hashes(width: int, tokens: str = "template", *salt: Column) -> Column:
    """The hash of each window of tokens; none for a shorter text."""
    last = F.size(tokens) - width + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(*salt, F.slice(tokens, i, width)))).otherwise(F.array().cast("array<long>"))


def slots(values: str, at: str, width: int) -> Column:
    return F.filter(F.slice(F.col(values), F.col(at) + 1, width), lambda x: F.startswith(x, F.lit(MARK)))


def counts(name: str, exact: Column) -> list[Column]:
    """Distinct windows: name_form of those with a template, name_all of all."""
    return [F.countDistinct(F.when(~exact, F.col("hash"))).alias(f"{name}_form"), F.countDistinct("hash").alias(f"{name}_all")]


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 6, share: float = 0.3, least: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per contaminated (document, item): doc_id, item_id, n_windows, n_item_windows, n_slots, covered.

    n_windows: distinct windows of the item in consistent alignments; covered: their share; n_slots:
    slots compared in them. At least `least` windows must match, or all if the item has fewer.
    Windows with more placeholders than words count by their exact tokens, and so does an item shorter
    than width, as one window. The limits hold for the template windows alone, or else, and then in
    the figures, for them and the exact ones together. Null and wordless texts match nothing. Null ids
    give no row. Repeated rows of a document give one row. Empty tables give an empty table.
    """
    items = canonical(benchmark, item_col, item_text, "item_id").where("item_id is not null")
    each = items.select("item_id", F.posexplode(hashes(width)).alias("at", "hash"), F.col("values"), F.col("plain"))
    each = each.select("item_id", F.col("at").alias("item_at"), "hash", slots("values", "at", width).alias("item_slots"), F.slice("plain", F.col("at") + 1, width).alias("tokens"))
    exact = each.where(F.size("item_slots") * 2 > width).select("item_id", "tokens")
    exact = exact.unionByName(items.where((F.size("plain") < width) & (F.col("plain")[0] != "")).select("item_id", F.col("plain").alias("tokens"))).distinct()
    lengths = sorted(r[0] for r in exact.select(F.size("tokens")).distinct().collect())
    salt = F.lit(1)  # keeps exact windows apart from templates
    places = each.where(F.size("item_slots") * 2 <= width).drop("tokens").dropDuplicates(["item_id", "item_at"])
    if lengths:
        none = F.array().cast("array<string>").alias("item_slots")
        places = places.unionByName(exact.select("item_id", F.lit(None).cast("int").alias("item_at"), F.xxhash64(salt, "tokens").alias("hash"), none))
    total = places.groupBy("item_id").agg(*counts("n_item", F.col("item_at").isNull()))
    found = canonical(docs, id_col, text_col, "doc_id").where("doc_id is not null")
    keys = F.concat(hashes(width), *(hashes(n, "plain", salt) for n in lengths)) if lengths else hashes(width)
    if places.count() <= BROADCAST_ROWS:
        met = found.select("doc_id", "values", F.posexplode(keys).alias("at", "hash")).join(F.broadcast(places), "hash")
    else:
        met = found.select("doc_id", F.posexplode(keys).alias("at", "hash")).join(places, "hash").join(found.select("doc_id", "values"), "doc_id")
    doc_slots = slots("values", "at", width)
    if lengths:
        doc_slots = F.when(F.col("item_at").isNull(), F.col("item_slots")).otherwise(doc_slots)
    met = met.select("doc_id", "item_id", "item_at", "hash", (F.col("at") - F.col("item_at")).alias("diagonal"), "item_slots", doc_slots.alias("doc_slots"))
    pairs = F.arrays_zip(F.col("item_slots").alias("i"), F.col("doc_slots").alias("d"))
    line = ["doc_id", "item_id", "diagonal"]  # exact windows have none
    met = met.select(*line, "hash", F.explode_outer(pairs).alias("pair"))
    lines = met.groupBy(*line, "hash", "pair").agg(F.lit(1)).groupBy(*line).agg(F.collect_set("hash").alias("hashes"), F.countDistinct("pair").alias("n_pairs"), F.countDistinct("pair.i").alias("n_values"))
    good = lines.where("n_pairs = n_values").select(*line, "n_values", F.explode("hashes").alias("hash"))
    per = good.groupBy("doc_id", "item_id").agg(*counts("n", F.col("diagonal").isNull()), F.max("n_values").alias("n_slots")).join(F.broadcast(total) if total.count() <= BROADCAST_ROWS else total, "item_id")

    def enough(n: str, of: str) -> Column:
        return (F.try_divide(n, of) >= share) & (F.col(n) >= F.least(F.lit(least), of))

    by_form = F.coalesce(enough("n_form", "n_item_form"), F.lit(False))
    per = per.where(by_form | enough("n_all", "n_item_all"))
    n, of = F.when(by_form, F.col("n_form")).otherwise(F.col("n_all")), F.when(by_form, F.col("n_item_form")).otherwise(F.col("n_item_all"))
    return per.select("doc_id", "item_id", n.alias("n_windows"), of.alias("n_item_windows"), "n_slots", (n / of).alias("covered"))
