"""Token counts by the whole-token shortcut.

Each worker proves once, offline, which vocabulary strings the library encodes alone as exactly
one token. A pre-token of a text that is one of them counts 1 without the library; only the
other pre-tokens are merged by it, once for each distinct word that a bounded memory still holds.
A chunk between white space whose characters leave the range for which splitting and lower-casing
are proved alike here and in the library (or that holds a special string) goes to it whole.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from krylith.llm import words as W

#: The split of the vocabulary file's pre-tokeniser (a fixed value).
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SAFE = regex.compile(r"[\x21-\x7e¡-ɏ]+")
_loaded: dict[str, Counter] = {}


def byte_strings() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, by their published rule."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Counts the tokens of words with one vocabulary file."""

    def __init__(self, path: str, memory: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.whole = self.proved(vocabulary)
        self.memo = W.Memo(1, memory)

    def encoded(self, texts: list[str]) -> list[int]:
        batch = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        return [len(e.ids) for e in batch(texts, add_special_tokens=False)]

    def proved(self, vocabulary: dict[str, int]) -> frozenset[str]:
        """The strings that are one pre-token and that the library encodes alone as one token."""
        back, found = byte_strings(), []
        for token in vocabulary:
            try:
                text = bytes(back[c] for c in token.removesuffix("</w>")).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if SAFE.fullmatch(text) and text == text.lower() and PRETOKEN.fullmatch(text):
                found.append(text)
        return frozenset(t for t, n in zip(found, self.encoded(found)) if n == 1)

    def words(self, chunks: list[str]) -> np.ndarray:
        """The number of tokens of each chunk."""
        counts, merge, owner = np.zeros(len(chunks), np.int64), [], []
        for i, chunk in enumerate(chunks):
            low = chunk.lower()
            if low in self.whole and SAFE.fullmatch(chunk):
                counts[i] = 1
            elif not SAFE.fullmatch(chunk) or any(s in chunk for s in self.special) or not unicodedata.is_normalized("NFC", chunk):
                merge.append(chunk)
                owner.append(i)
            else:
                for piece in PRETOKEN.findall(low):
                    if piece in self.whole:
                        counts[i] += 1
                    else:
                        merge.append(piece)
                        owner.append(i)
        if merge:
            np.add.at(counts, owner, self.encoded(merge))
        return counts

    def slice(self, rows: W.Slice) -> np.ndarray:
        """The number of tokens of each text."""
        rows.split()
        keys, first, inverse = np.unique(rows.hashes(), return_index=True, return_inverse=True)
        each = self.memo.get(keys, lambda missing: self.words(W.texts(rows, first[missing]))[:, None])[:, 0]
        return W.sums(each[inverse], rows.ptr)


def counter(name: str) -> Counter:
    path = name if os.path.isabs(name) else public_tokenizers.path(name)
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def token_counts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    vocabulary: a file of public_tokenizers, or an absolute path that every worker has. Null and
    empty texts have 0 bytes and 0 tokens. Repeated rows and null ids are kept; other columns
    are dropped. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            parts = list(W.slices(batch.column(1)))
            n_bytes = np.concatenate([np.diff(s.off) for s in parts] or [np.zeros(0, np.int64)])
            n_tokens = np.concatenate([count.slice(s) for s in parts] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
