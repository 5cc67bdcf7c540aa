"""Language identification of mixed texts.

Each word is scored under each language by hashed byte 4-grams with word edges. Script ranges
first narrow the languages that a word can be in. Viterbi over the words of a text, with a
penalty for each change of language, labels spans; the text's language is the one with the most
letters. The counts behind the scores come from all labelled training texts, and their size is
bounded by languages times BUCKETS.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from krylith.llm import words as W

BUCKETS = 1 << 16
SLICE_BYTES = 8 << 20
#: First and last code point of blocks by script (fixed values from the Unicode charts).
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("indic", 0x0900, 0x0DFF), ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
SCRIPT_BIT = {name: 1 << (i + 1) for i, name in enumerate(dict.fromkeys(s for s, _, _ in SCRIPTS))}


@cache
def letter_scripts() -> np.ndarray:
    """For each code point: 0 if it is no letter, else the bit of its script (1: none of those known)."""
    table = np.zeros(0x110000, np.uint16)
    table[[i for i in range(0x110000) if unicodedata.category(chr(i))[0] == "L"]] = 1
    for name, first, last in SCRIPTS:
        block = table[first : last + 1]
        block[block > 0] = SCRIPT_BIT[name]
    return table


def scripts_of(data: np.ndarray) -> np.ndarray:
    """For each byte that begins a letter the bit of its script, else 0."""
    table = letter_scripts()
    out = np.where(data < 128, table[np.minimum(data, 127)], 0).astype(np.uint16)
    for low, high, mask, more in ((0xC2, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF5, 0x07, 3)):
        at = np.flatnonzero((data >= low) & (data < high))
        at = at[at + more < data.size]
        code = (data[at] & mask).astype(np.int64)
        for k in range(1, more + 1):
            code = code << 6 | (data[at + k] & 0x3F)
        out[at] = table[np.minimum(code, 0x10FFFF)]
    return out


def bucket(grams: np.ndarray) -> np.ndarray:
    return ((grams * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


def features(rows: W.Slice) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the 4-gram that ends at each byte, and of the one at each word's end."""
    x = rows.data.copy()
    x[(x >= 65) & (x <= 90)] += 32
    x = x.astype(np.uint32)
    g = x.copy()
    for k in (1, 2, 3):
        g[k:] |= x[:-k] << np.uint32(8 * k)
    size, edge = rows.stops - rows.starts, np.uint32(32)
    for k in (0, 1, 2):
        at = rows.starts[size > k] + k
        g[at] = (g[at] & np.uint32((1 << 8 * (k + 1)) - 1)) | edge << np.uint32(8 * (k + 1))
    return bucket(g), bucket(g[rows.stops - 1] << np.uint32(8) | edge)


@dataclass
class Model:
    """langs; log probability of each bucket by language; the scripts that each language uses."""

    langs: list[str]
    logp: np.ndarray
    scripts: np.ndarray
    penalty: float = 15.0
    scale: float = 0.5

    def scores(self, rows: W.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each word by language, and its number of letters."""
        grams, ends = features(rows)
        script = scripts_of(rows.data)
        letters = np.r_[0, np.cumsum(script > 0)]
        letters = letters[rows.stops] - letters[rows.starts]
        bits = np.bitwise_or.reduceat(script, rows.starts) if rows.starts.size else script[:0]
        out = np.empty((rows.starts.size, len(self.langs)), np.float32)
        total = np.zeros(rows.data.size + 1)
        for k in range(len(self.langs)):
            np.cumsum(self.logp[k][grams], out=total[1:])
            out[:, k] = total[rows.stops] - total[rows.starts] + self.logp[k][ends]
        out *= self.scale
        allowed = (bits[:, None] & self.scripts[None, :]) > 0
        some = allowed.any(1)
        out[(~allowed) & some[:, None]] = -1e4
        out -= out.max(1, keepdims=True) if len(self.langs) else 0
        out[(letters == 0) | ~some] = 0
        return out, letters

    def labels(self, score: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """The language of each word on the best path of its text; all texts advance together."""
        length = np.diff(ptr)
        order = np.argsort(-length, kind="stable")
        begin, length = ptr[:-1][order], length[order]
        n, k = score.shape
        small = np.int8 if k < 128 else np.int32
        back, label = np.zeros((n, k), small), np.zeros(n, small)
        own, v = np.arange(k, dtype=small)[None, :], np.zeros((order.size, k), np.float32)
        steps = int(length[0]) if length.size else 0
        active = np.searchsorted(-length, -np.arange(steps), "left")
        for t in range(steps):
            a = active[t]
            at, w = begin[:a] + t, v[:a]
            best = w.max(1, keepdims=True) - self.penalty
            stay = w >= best
            back[at] = np.where(stay, own, w.argmax(1)[:, None])
            v[:a] = np.where(stay, w, best) + score[at]
        state = v.argmax(1).astype(small) if k else np.zeros(order.size, small)
        for t in range(steps - 1, -1, -1):
            a = active[t]
            at = begin[:a] + t
            label[at] = state[:a]
            state[:a] = back[at, state[:a]]
        return label


def fit(docs: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts the buckets and scripts of all training texts with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for rows in W.slices(batch.column(0)):
                rows.split()
                if not rows.starts.size:
                    continue
                grams, ends = features(rows)
                byte_doc = np.repeat(np.arange(rows.n), np.diff(rows.off))
                script = scripts_of(rows.data)
                for lang in set(langs[rows.at : rows.at + rows.n].tolist()):
                    of = langs[rows.at : rows.at + rows.n] == lang
                    have = counts.setdefault(lang, np.zeros(BUCKETS + 32, np.int64))
                    mine = of[byte_doc]
                    have[:BUCKETS] += np.bincount(grams[mine & rows.solid], minlength=BUCKETS)
                    have[:BUCKETS] += np.bincount(ends[of[rows.docs()]], minlength=BUCKETS)
                    bits, n = np.unique(script[mine], return_counts=True)
                    for bit, c in zip(bits.tolist(), n.tolist()):
                        have[BUCKETS + bit.bit_length()] += c
        for lang, have in counts.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * at.size, pa.string()), pa.array(at, pa.int32()), pa.array(have[at], pa.int64())], ["lang", "bucket", "n"])

    picked = docs.where(training & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").cast("binary").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    # at most (number of languages) * (BUCKETS + 32) rows reach the driver
    found = picked.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique().tolist())
    logp, scripts = np.zeros((len(langs), BUCKETS), np.float32), np.zeros(len(langs), np.uint16)
    for k, lang in enumerate(langs):
        rows = found[found["lang"] == lang]
        table = np.zeros(BUCKETS + 32)
        table[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
        grams, script = table[:BUCKETS], table[BUCKETS + 1 :]
        logp[k] = np.log((grams + 0.1) / (grams.sum() + 0.1 * BUCKETS))
        share = script / max(script.sum(), 1)
        scripts[k] = sum(1 << i for i in range(16) if i < share.size and share[i] > 0.001)
    return Model(langs, logp, scripts)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score and the labelled spans of words [first, past).

    A null text, or one without a letter, gets `und` with score 0 and no spans; so do all texts if
    the model knows no language. score is the share of letters in lang_pred. Ties go to the
    first language by name. Repeated rows are kept, other columns dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, "und"], object)
        for batch in batches:
            predicted, share, counts, firsts, pasts, kinds = [], [], [], [], [], []
            for rows in W.slices(batch.column(1), SLICE_BYTES):
                rows.split()
                score, letters = model.scores(rows) if model.langs else (np.zeros((rows.starts.size, 0), np.float32), np.zeros(rows.starts.size, np.int64))
                docs_of = rows.docs()
                k = len(model.langs)
                if not k or not score.shape[0]:
                    predicted.append(np.full(rows.n, k))
                    share.append(np.zeros(rows.n))
                    counts.append(np.zeros(rows.n, np.int64))
                    continue
                label = model.labels(score, rows.ptr).astype(np.int64)
                by_lang = np.bincount(docs_of * k + label, letters, rows.n * k).reshape(rows.n, k)
                total = by_lang.sum(1)
                predicted.append(np.where(total > 0, by_lang.argmax(1), k))
                share.append(by_lang.max(1) / np.maximum(total, 1))
                edge = np.r_[True, (label[1:] != label[:-1]) | (docs_of[1:] != docs_of[:-1])] & (total[docs_of] > 0)
                at = np.flatnonzero(edge)
                last = np.r_[at[1:], label.size] if at.size else at
                last = np.minimum(last, rows.ptr[docs_of[at] + 1])
                counts.append(np.bincount(docs_of[at], minlength=rows.n))
                firsts.append(at - rows.ptr[docs_of[at]])
                pasts.append(last - rows.ptr[docs_of[at]])
                kinds.append(label[at])
            if not predicted:
                continue
            join = lambda xs: np.concatenate(xs or [np.zeros(0, np.int64)])
            spans = pa.StructArray.from_arrays([pa.array(join(firsts), pa.int32()), pa.array(join(pasts), pa.int32()), pa.array(names[join(kinds)].tolist(), pa.string())], ["first", "past", "lang"])
            listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(join(counts))], pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[join(predicted)].tolist(), pa.string()), pa.array(np.concatenate(share), pa.float64()), listed], ["doc_id", "lang_pred", "score", "spans"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return picked.mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<first:int,past:int,lang:string>>")
