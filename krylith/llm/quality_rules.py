"""Quality rules by tokeniser fertility.

A public vocabulary encodes each word; a text's characters per token, share of byte-fallback
tokens and entropy of tokens must lie in the band of its language, or else of its main script.
Natural prose of one length has a narrow range of token entropy, so the floor of the entropy is
a curve over the number of tokens. Bands on ratios hold from min_tokens tokens.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from krylith.llm import words as W

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
REPEAT_WIDTH = 5


@dataclass(frozen=True)
class Band:
    """What a text must meet: characters per token, most byte-fallback share, entropy (floor by number of tokens)."""

    chars_low: float
    chars_high: float
    byte_share: float
    floor: tuple[tuple[float, float], ...]
    min_tokens: int = 400

    def holds(self, tokens: np.ndarray, chars: np.ndarray, fallback: np.ndarray, entropy: np.ndarray) -> np.ndarray:
        n = np.maximum(tokens, 1)
        ratio = chars / n
        low = np.interp(np.log2(n), np.log2([x for x, _ in self.floor]), [y for _, y in self.floor])
        settled = tokens >= self.min_tokens
        return ~(settled & ((ratio < self.chars_low) | (ratio > self.chars_high))) & (fallback <= self.byte_share * n) & (entropy >= low)


FLOOR = ((10, 2.0), (60, 4.2), (150, 5.3), (400, 5.95), (1200, 6.3), (5000, 6.4))
LOOSE = ((10, 1.0), (60, 3.0), (400, 4.0), (5000, 4.5))
#: By language, then by script (a name in capitals); OTHER is the last resort.
BANDS = {
    "en": Band(1.95, 4.8, 0.05, FLOOR),
    "de": Band(2.02, 4.8, 0.05, FLOOR),
    "fr": Band(1.83, 4.8, 0.05, FLOOR),
    "es": Band(1.79, 4.8, 0.05, FLOOR),
    "LATIN": Band(1.5, 6.0, 0.1, FLOOR),
    "GREEK": Band(0.5, 5.0, 0.6, LOOSE),
    "CYRILLIC": Band(0.8, 6.0, 0.5, LOOSE),
    "OTHER": Band(0.2, 6.0, 1.0, LOOSE),
}
SCRIPTS = ("NONE", "LATIN", "GREEK", "CYRILLIC", "OTHER")
#: The script that a UTF-8 lead byte points to.
LEAD = np.zeros(256, np.uint8)
LEAD[65:91] = LEAD[97:123] = LEAD[0xC3:0xCA] = 1
LEAD[0xCE:0xD0] = 2
LEAD[0xD0:0xD4] = 3
LEAD[0xD4:0xF5] = 4

_loaded: dict[str, Pieces] = {}


class Pieces:
    """Token ids of single words, kept in a bounded memory."""

    INLINE = 8

    def __init__(self, path: str, memory: int = 700_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.fallback = np.array([self.model.is_byte(i) or self.model.is_unknown(i) for i in range(self.size)])
        self.memo = W.Memo(self.INLINE + 2, memory, np.int32)
        self.long: dict[int, np.ndarray] = {}

    def look(self, keys: np.ndarray, rows: W.Slice, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: number of tokens, of fallback tokens; all token ids one after the other."""

        def compute(missing: np.ndarray) -> np.ndarray:
            found = self.model.encode(W.texts(rows, first[missing]), num_threads=1)
            n = np.fromiter(map(len, found), np.int64, len(found))
            flat, ptr = np.fromiter(chain.from_iterable(found), np.int32, int(n.sum())), np.r_[0, np.cumsum(n)]
            out = np.zeros((missing.size, self.INLINE + 2), np.int32)
            out[:, 0], out[:, 1] = n, W.sums(self.fallback[flat], ptr)
            for k in range(self.INLINE):
                has = n > k
                out[has, 2 + k] = flat[ptr[:-1][has] + k]
            for i in np.flatnonzero(n > self.INLINE).tolist():
                self.long[int(keys[missing[i]])] = flat[ptr[i] : ptr[i + 1]].copy()
            return out

        if len(self.long) > self.memo.limit // 10:
            self.long = {}
            self.memo.clear()
        got = self.memo.get(keys, compute)
        counts = got[:, 0]
        ids = np.empty(int(counts.sum()), np.int32)
        start = np.cumsum(counts) - counts
        for k in range(self.INLINE):
            has = counts > k
            ids[start[has] + k] = got[has, 2 + k]
        for i in np.flatnonzero(counts > self.INLINE):
            if int(keys[i]) not in self.long:  # forgotten meanwhile
                self.long[int(keys[i])] = np.array(self.model.encode(rows.word(int(first[i])).decode("utf-8", "replace")), np.int32)
            ids[start[i] : start[i] + counts[i]] = self.long[int(keys[i])]
        return counts.astype(np.int64), got[:, 1].astype(np.int64), ids


def pieces(name: str) -> Pieces:
    path = name if os.path.isabs(name) else public_tokenizers.path(name)
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def expand(counts: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Indices into the rows of a ragged table, for the rows each in turn; row r has counts[r] entries."""
    start, n = (np.cumsum(counts) - counts)[each], counts[each]
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


def entropy(docs: np.ndarray, ids: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """Bits of entropy of the ids of each text."""
    total = np.bincount(docs, minlength=n_docs).astype(float)
    keys = np.sort(docs.astype(np.uint64) * np.uint64(size) + ids.astype(np.uint64))
    if not keys.size:
        return np.zeros(n_docs)
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    c = np.diff(np.r_[edge, keys.size]).astype(float)
    weighted = np.bincount((keys[edge] // np.uint64(size)).astype(np.int64), c * np.log2(c), n_docs)
    return np.log2(np.maximum(total, 1)) - weighted / np.maximum(total, 1)


def repeated(hashes: np.ndarray, ptr: np.ndarray, width: int = REPEAT_WIDTH) -> np.ndarray:
    """Whether each word lies in a window of width words found twice or more in its text."""
    keys, at, docs = W.windows(hashes, ptr, width)
    covered = np.zeros(hashes.size + 1, np.int64)
    if keys.size:
        order = np.argsort(keys, kind="stable")
        order = order[np.argsort(docs[order], kind="stable")] if docs[-1] else order
        k, d = keys[order], docs[order]
        same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
        twice = np.zeros(keys.size, bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + width, -1)
    return np.cumsum(covered)[:-1] > 0


def duplicate_lines(rows: W.Slice) -> np.ndarray:
    """The lines with a word that equal an earlier line of their text."""
    breaks = np.flatnonzero(rows.data == 10)
    edges = np.unique(np.r_[rows.off, breaks, breaks + 1])
    start, stop = edges[:-1], edges[1:]
    words = np.r_[0, np.cumsum(rows.solid)]
    real = words[stop] > words[start]
    start, stop = start[real], stop[real]
    docs = np.searchsorted(rows.off, start, "right") - 1
    keys = W.spans_hash(W.BYTES[rows.data], start, stop)
    distinct = np.unique(np.stack([docs.astype(np.uint64), keys]), axis=1)[0].astype(np.int64) if keys.size else docs
    return np.bincount(docs, minlength=rows.n) - np.bincount(distinct, minlength=rows.n)


def measures(rows: W.Slice, model: Pieces) -> dict[str, np.ndarray]:
    """All measures of the texts of a slice."""
    rows.split()
    h = rows.hashes()
    head = (rows.data & 0xC0) != 0x80
    keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    counts, fallback, ids = model.look(keys, rows, first)
    lead = LEAD[rows.data]
    by_script = np.stack([np.zeros(rows.n)] + [W.sums(lead == k, rows.off) if (lead == k).any() else np.zeros(rows.n) for k in range(1, len(SCRIPTS))])
    token_docs = np.repeat(rows.docs(), counts[inverse])
    return {
        "n_words": np.diff(rows.ptr),
        "word_chars": W.sums(head & rows.solid, rows.off),
        "n_symbols": W.sums(SYMBOLS[rows.data], rows.off),
        "n_dup_lines": duplicate_lines(rows),
        "n_repeat_words": W.sums(repeated(h, rows.ptr), rows.ptr),
        "n_tokens": W.sums(counts[inverse], rows.ptr),
        "n_fallback": W.sums(fallback[inverse], rows.ptr),
        "entropy": entropy(token_docs, ids[expand(counts, inverse)], rows.n, model.size),
        "script": by_script.argmax(0),
    }


def quality_rules(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", bands: dict[str, Band] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row per input row: doc_id, the measures, base_failed and kept.

    A null or empty text has no words and fails. Texts of under 10 words, or with over a fifth
    of their words in repeated five-word windows, fail; others are kept if they lie in the band
    of their lang, else of their main script. Repeated rows are judged alike; other columns are
    dropped; an empty table gives an empty table.
    """
    bands = BANDS if bands is None else bands
    ints = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_fallback"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(vocabulary)
        for batch in batches:
            parts = [measures(s, model) for s in W.slices(batch.column(1))]
            if not parts:
                continue
            m = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
            names = np.array([lang if lang in bands else SCRIPTS[s] if SCRIPTS[s] in bands else "OTHER" for lang, s in zip(batch.column(2).to_pylist(), m["script"].tolist())], object)
            good = np.zeros(names.size, bool)
            for name in set(names.tolist()):
                at = names == name
                good[at] = bands[name].holds(m["n_tokens"][at], m["word_chars"][at], m["n_fallback"][at], m["entropy"][at])
            columns = [batch.column(0), *(pa.array(m[k], pa.int64()) for k in ints), pa.array(m["entropy"], pa.float64()), pa.array(names.tolist(), pa.string()), pa.array(failed), pa.array(good & ~failed)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *ints, "token_entropy", "band", "base_failed", "kept"])

    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), lang.alias("lang"))
    return picked.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in ints) + ", token_entropy double, band string, base_failed boolean, kept boolean")
