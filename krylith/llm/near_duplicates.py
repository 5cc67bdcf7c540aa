"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

Signatures: every shingle has a seeded permutation of the slots; the value it offers to a slot is
the rank of the slot in its permutation plus a uniform fraction, and a slot keeps the least. The
ranks of one shingle are correlated over the slots, which lowers the variance below that of
independent hashes. Rank r is worked off for all shingles of a text before rank r+1, so a text
stops as soon as each slot has a value: no later rank can be less.

Texts with equal shingle sets are one class, found by a 128-bit sum of their shingles, and go on as
one representative. Representatives that agree in a band share a bucket. In a bucket one pivot is
compared with all others on full sets; members that end in one component need no more. For what
is left, the shingles that no other open member has are counted: they bound every similarity of
their text, so members that can reach no other, and pairs that can't reach the limit, go without a
comparison. The rest compares further pivots, four times as many in each round, only across
components and in the first bucket that both share, until no bucket holds two. So a group of copies costs a comparison for each member,
while no pair of different components of a bucket that could be a link stays uncompared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from krylith.llm import words as W
from krylith.llm.components import components
from krylith.llm.tables import Scratch

#: Chance that a pair at similarity 0.85 shares no band: (1 - 0.85**6)**24 = 1.2e-5.
BANDS, ROWS = 24, 6
TABLE = 4096


def permutations(slots: int, seed: int = 7) -> np.ndarray:
    """TABLE seeded permutations of the slots; a shingle picks one and rotates it."""
    random = np.random.RandomState(seed)
    return np.argsort(random.rand(TABLE, slots), axis=1).astype(np.uint16)


_permutations: dict[int, np.ndarray] = {}


def shingles(rows: W.Slice, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted set of shingle hashes of each text, one after the other, and where each begins."""
    rows.split()
    h = rows.hashes(fold=True)
    n_words = np.diff(rows.ptr)
    keys, _, docs = W.windows(h, rows.ptr, width)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if short.size:
        keys = np.r_[keys, W.spans_hash(h, rows.ptr[short], rows.ptr[short + 1], W._WINDOW_BASE)]
        docs = np.r_[docs, short]
        order = np.argsort(docs, kind="stable")
        keys, docs = keys[order], docs[order]
    ptr = np.searchsorted(docs, np.arange(rows.n + 1))
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist()):
        keys[a:b].sort()
    new = np.ones(keys.size, bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    return keys[new], np.r_[0, np.cumsum(np.bincount(docs[new], minlength=rows.n))]


def signatures(keys: np.ndarray, ptr: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash of each set; an empty set keeps the largest value everywhere."""
    if slots not in _permutations:
        _permutations[slots] = permutations(slots)
    ranks, n = _permutations[slots], ptr.size - 1
    sig = np.full(n * slots, np.iinfo(np.uint64).max, np.uint64)
    docs = np.repeat(np.arange(n), np.diff(ptr))
    pick, turn = (keys & W.U(TABLE - 1)).astype(np.int64), (keys >> W.U(12)) % W.U(slots)
    for rank in range(slots):
        slot = (ranks[pick, rank].astype(np.uint64) + turn) % W.U(slots)
        part = W.mixed(keys ^ W.U((rank + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> W.U(16)
        np.minimum.at(sig, docs * slots + slot.astype(np.int64), part | W.U(rank) << W.U(48))
        open_ = (sig.reshape(n, slots) == np.iinfo(np.uint64).max).any(1)
        more = open_[docs]
        if not more.any():
            break
        if not more.all():
            keys, docs, pick, turn = keys[more], docs[more], pick[more], turn[more]
    return sig.reshape(n, slots)


def bands(sig: np.ndarray, count: int, rows: int) -> np.ndarray:
    """One hash for each band of each signature."""
    part = sig.reshape(-1, count, rows)
    h = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64) * W.U(0xA24BAED4963EE407), part.shape[:2])
    for k in range(rows):
        h = W.mixed(h * W.U(0x9FB21C651E98DF25) + part[:, :, k])
    return h


def sketch(docs: DataFrame, width: int, count: int, rows_in_band: int) -> DataFrame:
    """doc_id, n (size of the set), fp1, fp2 (its fingerprint) and the band hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in W.slices(batch.column(1)):
                keys, ptr = shingles(rows, width)
                total = [np.r_[W.U(0), np.cumsum(W.mixed(keys ^ W.U(c)))] for c in (0x1B873593CC9E2D51, 0x38B34AE5A1E38B93)]
                fp = [(t[ptr[1:]] - t[ptr[:-1]]).view(np.int64) for t in total]
                hashed = bands(signatures(keys, ptr, count * rows_in_band), count, rows_in_band).view(np.int64)
                full = np.diff(ptr) > 0
                listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(full * count)], pa.int32()), pa.array(hashed[full].ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows.at : rows.at + rows.n], pa.array(np.diff(ptr), pa.int64()), pa.array(fp[0]), pa.array(fp[1]), listed], ["doc_id", "n", "fp1", "fp2", "bands"])

    return docs.mapInArrow(run, "doc_id long, n long, fp1 long, fp2 long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, width: int, least: int, of: int) -> DataFrame:
    """The pairs (a, b) whose full sets satisfy of * intersection >= least * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            n = batch.num_rows
            column = pa.chunked_array([batch.column(2), batch.column(3)]).combine_chunks()
            distinct, first, inverse = np.unique(ids, return_index=True, return_inverse=True)
            sets = []
            for rows in W.slices(column.take(pa.array(first))):
                keys, ptr = shingles(rows, width)
                sets += [keys[x:y] for x, y in zip(ptr[:-1].tolist(), ptr[1:].tolist())]
            good = np.zeros(n, bool)
            for i, (x, y) in enumerate(zip(inverse[:n].tolist(), inverse[n:].tolist())):
                p, q = (sets[x], sets[y]) if sets[x].size <= sets[y].size else (sets[y], sets[x])
                at = np.minimum(np.searchsorted(q, p), max(q.size - 1, 0))
                both = int((q[at] == p).sum()) if q.size else 0
                good[i] = of * both >= least * (p.size + q.size - both) and both > 0
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], ["a", "b"])

    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def shared_sizes(texts: DataFrame, width: int) -> DataFrame:
    """doc_id and the number of its shingles that another of these texts has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in W.slices(batch.column(1)):
                keys, ptr = shingles(rows, width)
                ids = batch.column(0)[rows.at : rows.at + rows.n].take(pa.array(np.repeat(np.arange(rows.n), np.diff(ptr))))
                yield pa.RecordBatch.from_arrays([ids, pa.array(keys.view(np.int64))], ["doc_id", "key"])

    each = texts.select("doc_id", "text").mapInArrow(run, "doc_id long, key long").groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    return each.where("n = 1").groupBy("doc_id").agg(F.count("*").alias("alone"))


def near_duplicates(docs: DataFrame, least: int = 85, of: int = 100, width: int = 5, count: int = BANDS, rows_in_band: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are lower-cased in A-Z only; a text of fewer words than width is one shingle; null and
    wordless texts have none, link with nothing and are kept. An id stands for one text; rows that
    repeat it get one component. A row with a null id links with nothing, has a null component
    and is kept. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    sketched = scratch.save(sketch(picked, width, count, rows_in_band))
    classes = scratch.save(sketched.where("n > 0 and doc_id is not null").groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")))
    members = classes.select(F.explode("bands").alias("bucket"), F.col("rep"), "n")
    shared = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("rep").alias("pivot")).where("size > 1")
    members = scratch.save(members.join(shared, "bucket").select("bucket", "rep", "n", "pivot"))
    texts = scratch.save(picked.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    sizes = classes.select("rep", "n")

    fits = F.least("n", "pivot_n") * of >= F.greatest("n", "pivot_n") * least
    most = F.least("m", "pivot_m")
    reach = most * of >= (F.col("n") + F.col("pivot_n") - most) * least
    first = members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b"), "n").distinct()
    first = first.join(sizes.toDF("a", "pivot_n"), "a").where(fits).select("a", "b")
    tried = scratch.save(first)
    links = scratch.save(verified(tried, texts, width, least, of).toDF("u", "v"))
    open_ = members.where("rep <> pivot").select("bucket", "rep", "n")  # the pivot has met all others
    pivots, labels = 4, components(links, scratch)
    while True:
        named = open_.join(labels.toDF("rep", "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        mixed = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
        left = scratch.save(named.join(mixed, "bucket"))
        if left.isEmpty():
            break
        alone = shared_sizes(texts.join(left.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), width)
        left = left.join(alone.withColumnRenamed("doc_id", "rep"), "rep", "left").withColumn("m", F.col("n") - F.coalesce("alone", F.lit(0)))
        left = left.where(F.col("m") * of >= F.col("n") * least).drop("alone").join(classes.select("rep", "bands"), "rep")
        turn = F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64("rep"), "rep"))
        ranked = scratch.save(left.withColumn("turn", turn))
        chosen = ranked.where(F.col("turn") <= pivots).select("bucket", F.col("rep").alias("pivot"), F.col("n").alias("pivot_n"), F.col("m").alias("pivot_m"), F.col("label").alias("pivot_label"), F.col("turn").alias("pivot_turn"), F.col("bands").alias("pivot_bands"))
        met = ranked.join(chosen, "bucket").where((F.col("label") != F.col("pivot_label")) & (F.col("turn") > F.col("pivot_turn")) & fits & reach & (F.array_min(F.array_intersect("bands", "pivot_bands")) == F.col("bucket")))
        met = met.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        new = scratch.save(met)
        found = scratch.save(verified(new, texts, width, least, of).toDF("u", "v"))
        tried, links = tried.unionByName(new), links.unionByName(found)
        if not found.isEmpty():
            labels = components(labels.toDF("u", "v").unionByName(found), scratch)
        open_ = ranked.where(F.col("turn") > pivots).select("bucket", "rep", "n")
        pivots *= 4
    known = classes.join(labels.toDF("rep", "label"), "rep", "left").select("fp1", "fp2", "n", F.coalesce("label", "rep").alias("label"))
    named = sketched.select("doc_id", "n", "fp1", "fp2").join(known, ["fp1", "fp2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
