"""Exact substring deduplication with a log-structured fingerprint index.

Every window of `width` words has one fingerprint: the least hash among its runs of GRAM words. Equal
windows have equal fingerprints, and a text has one only at about each twelfth word, so the index
holds a twelfth of the windows' number. It is a list of immutable runs (hash, n), each in buckets
sorted by hash. A batch of documents is aggregated in the same buckets, merge-joined with the runs,
which are neither exchanged nor sorted again, and written as a new run; FANOUT runs of one level are
compacted into one of the next, so a batch meets few runs however many came before it.

A fingerprint that recurs only makes its windows candidates. Candidates are verified by a 128-bit
hash of all their words: one aggregation finds those that occur once, and only these go back to the
texts. Words of the other candidates are removed. All recurrences are judged on the input, so the
order of batches has no influence. Places are kept by row, so rows without or with equal ids are
rows of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from krylith.llm import words as W
from krylith.llm.tables import Scratch

GRAM = 12
SECOND_BASE = 0xAF251AF3B0F025B5
#: Lets Spark use that a bucket of one file is sorted.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over values[i:i+width] for each i, by doubling; the last width-1 entries see fewer."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        if step < out.size:
            out[:-step] = pick(out[:-step], out[step:].copy())
        have += step
    return out


def anchors(rows: W.Slice, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor and first word of each window, and its text; hash and text of each place that is an anchor; word hashes."""
    rows.split()
    h = rows.hashes()
    grams, _, gram_docs = W.windows(h, rows.ptr, gram)
    n_words = np.diff(rows.ptr)
    counts = np.maximum(n_words - width + 1, 0)
    docs = np.repeat(np.arange(rows.n), counts)
    offset = np.arange(docs.size) - np.repeat(np.cumsum(counts) - counts, counts)
    first_gram = np.cumsum(np.maximum(n_words - gram + 1, 0)) - np.maximum(n_words - gram + 1, 0)
    at = first_gram[docs] + offset
    span = width - gram + 1
    least = sliding(grams, span, np.minimum)[at]
    seen = np.zeros_like(grams)
    seen[at] = least
    chosen = sliding(seen[::-1].copy(), span, np.maximum)[::-1] == grams if grams.size else np.zeros(0, bool)
    return least, rows.ptr[docs] + offset, docs, grams[chosen], gram_docs[chosen], h


def fingerprints(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """row and the anchors of each text, one entry for each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in W.slices(batch.column(1)):
                _, _, _, found, where, _ = anchors(rows, width, gram)
                ptr = np.searchsorted(where, np.arange(rows.n + 1))
                listed = pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows.at : rows.at + rows.n], listed], ["row", "hashes"])

    return docs.select("row", "text").mapInArrow(run, "row long, hashes array<long>").where(F.size("hashes") > 0)


class FingerprintIndex:
    """Immutable runs of (hash, n), sorted in buckets. A run of level k + 1 is compacted from FANOUT runs of level k.

    buckets: as many as the session has shuffle partitions if not given, so that the grouping of a run already
    deals it to its buckets. path: a folder to keep the runs in, named by level, number and buckets; an
    index that is there is opened.
    """

    FANOUT = 4
    SCHEMA = "hash BIGINT, n BIGINT"

    def __init__(self, scratch: Scratch, buckets: int | None = None, path: str | None = None):
        self.buckets = buckets or int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
        self.scratch, self.path, self.levels, self.written, self.compactions = scratch, path, [[]], 0, 0
        for name in scratch.names(path) if path else []:
            level, number, dealt = map(int, name.split("-")[1:])
            self.levels += [[] for _ in range(level + 1 - len(self.levels))]
            self.levels[level].append(scratch.open_sorted(f"{path}/{name}", self.SCHEMA, "hash", dealt))
            self.written = max(self.written, number + 1)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def write(self, frame: DataFrame, level: int) -> DataFrame:
        run = frame.groupBy("hash").agg(F.sum("n").alias("n"))
        path = f"{self.path}/run-{level}-{self.written}-{self.buckets}" if self.path else None
        self.written += 1
        return self.scratch.save_sorted(run, "hash", self.buckets, path)

    def ingest(self, hashes: DataFrame) -> DataFrame:
        """Adds a batch (column hash, one row for each place); gives the hashes that it makes recur: those that recur already were given before."""
        spark = hashes.sparkSession
        new = self.write(hashes.select("hash", F.lit(1).cast("long").alias("n")), 0)
        recurs = new.where("n > 1").select("hash")
        for run in self.runs():
            recurs = recurs.unionByName(new.join(run.where("n = 1").select("hash"), "hash", "left_semi").select("hash"))
        before = spark.conf.get(ORDERED, "false")
        spark.conf.set(ORDERED, "true")  # a bucket is one sorted file, or Spark sorts it
        try:
            recurs = self.scratch.save(recurs)
        finally:
            spark.conf.set(ORDERED, before)
        self.levels[0].append(new)
        level = 0
        while len(self.levels[level]) >= self.FANOUT:
            self.compact(level)
            level += 1
        return recurs

    def compact(self, level: int) -> None:
        """Merges all runs of a level into one of the next and removes them."""
        old, self.levels[level] = self.levels[level], []
        merged = old[0]
        for run in old[1:]:
            merged = merged.unionByName(run)
        if len(self.levels) == level + 1:
            self.levels.append([])
        self.levels[level + 1].append(self.write(merged, level + 1))
        self.compactions += 1
        self.scratch.drop(*old)


def candidates(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """docs: row, text, hashes (its recurring anchors). Two hashes and the place of each candidate window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, h, first, doc in marked(batch, width, gram):
                ids = batch.column(0)[rows.at : rows.at + rows.n]
                one = W.spans_hash(h, first, first + width, W._WINDOW_BASE)
                two = W.spans_hash(W.mixed(h ^ W.U(0x5851F42D4C957F2D)), first, first + width, SECOND_BASE)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), ids.take(pa.array(doc)), pa.array((first - rows.ptr[doc]), pa.int32())], ["one", "two", "row", "at"])

    return docs.select("row", "text", "hashes").mapInArrow(run, "one long, two long, row long, at int")


def marked(batch: pa.RecordBatch, width: int, gram: int) -> Iterator[tuple[W.Slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each slice of row, text, hashes: hashes of its words; first word and text of the windows with a recurring anchor."""
    listed = batch.column(2)
    for rows in W.slices(batch.column(1)):
        least, first, docs, _, _, h = anchors(rows, width, gram)
        part = listed[rows.at : rows.at + rows.n]
        known = np.unique(part.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
        if known.size:
            hit = known[np.minimum(np.searchsorted(known, least), known.size - 1)] == least
        else:
            hit = np.zeros(least.size, bool)
        first, docs = first[hit], docs[hit]
        yield rows, h, first, docs


def cut(docs: DataFrame, width: int, gram: int, with_text: bool) -> DataFrame:
    """docs: row, text, hashes, single (places of candidates that occur once), doc_id. The remaining words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, first, doc in marked(batch, width, gram):
                place = first - rows.ptr[doc]
                single = batch.column(3)[rows.at : rows.at + rows.n]
                wide = np.int64(1 << 40)
                lone = np.repeat(np.arange(rows.n), np.asarray(single.value_lengths().fill_null(0))) * wide + single.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                first = first[~np.isin(doc * wide + place, lone)]
                edge = np.zeros(rows.starts.size + 1, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + width, -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept, digest = [], []
                raw, starts, stops = rows.data.tobytes(), rows.starts, rows.stops
                for i in range(rows.n):
                    a, b = rows.ptr[i], rows.ptr[i + 1]
                    stay = np.flatnonzero(~gone[a:b]) + a
                    text = b" ".join([raw[x:y] for x, y in zip(starts[stay].tolist(), stops[stay].tolist())])
                    kept.append(text if stay.size < b - a else batch.column(1)[rows.at + i].as_py())
                    digest.append(hashlib.sha256(text).hexdigest())
                columns = [*(batch.column(k)[rows.at : rows.at + rows.n] for k in (4, 0)), pa.array(np.diff(rows.ptr), pa.int64()), pa.array(W.sums(gone, rows.ptr), pa.int64()), pa.array(digest, pa.string())]
                if with_text:
                    columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
                if carried:
                    columns.append(batch.column(5)[rows.at : rows.at + rows.n])
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType.fromDDL("doc_id long, row long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    carried = "carried" in docs.columns
    if carried:
        schema.add(docs.schema["carried"])
    names = schema.names
    return docs.select("row", "text", "hashes", "single", "doc_id", *["carried"] * carried).mapInArrow(run, schema)


def substring_dedup(docs: DataFrame, width: int = 35, batches: int = 5, gram: int = GRAM, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, carry: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (and kept_text if asked for: a text that loses nothing as it is, null too).

    batches: the documents enter the index in so many parts. Null and short texts lose nothing. A
    repeated row is the same sequence at another place, so both lose their windows, and so are rows
    with a null id or with the id of another text: each is judged and counted as a row. row_col: a
    column that numbers the rows; the result then has it as row. carry: the result has the input's other
    columns as a struct, carried. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession)
    extra = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col), F.lit(0).alias("_last")).alias("carried")] if carry else []
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    texts = scratch.save(docs.select(row.cast("long").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), *extra))
    prints = scratch.save(fingerprints(texts, width, gram))
    index = FingerprintIndex(scratch)
    recurs = None
    for part in range(batches):
        batch = prints.where(F.pmod(F.xxhash64("row"), F.lit(batches)) == part)
        found = index.ingest(batch.select(F.explode("hashes").alias("hash")))
        recurs = found if recurs is None else recurs.unionByName(found)
    each = prints.select("row", F.explode(F.array_distinct("hashes")).alias("hash"))
    hits = scratch.save(each.join(recurs, "hash", "left_semi").groupBy("row").agg(F.collect_list("hash").alias("hashes")))
    scratch.drop(prints, *index.runs())
    windows = candidates(texts.select("row", "text").join(hits, "row"), width, gram).groupBy("one", "two").agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min("at").alias("at"))
    lone = scratch.save(windows.where("n = 1").groupBy("row").agg(F.collect_list("at").alias("single")))
    marks = hits.join(lone, "row", "left")
    found = texts.join(marks, "row", "left").withColumns({"hashes": F.coalesce("hashes", F.array().cast("array<long>")), "single": F.coalesce("single", F.array().cast("array<int>"))})
    found = cut(found, width, gram, with_text)
    return found if row_col else found.drop("row")
