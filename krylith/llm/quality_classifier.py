"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into chunks that overlap by as much as a filter is wide beyond its stride, so the
filters see every place of the whole text. Each chunk is max-pooled; the text's features are the
largest and the mean of its chunks' values, and a logistic unit combines them into one
probability. Training takes at most `sample` labelled documents of each class, all chunks of each;
scoring takes all of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from krylith.llm import words as W

STRIDE = 4
WIDTH = 2 * STRIDE
WINDOWS = 128
CHUNK = STRIDE * (WINDOWS + 1)


def chunks(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunks of each text, padded with zero bytes, and the text of each."""
    size = np.diff(off)
    step = CHUNK - STRIDE
    count = np.where(size > 0, np.maximum(1, -(-(size - STRIDE) // step)), 0)
    docs = np.repeat(np.arange(size.size), count)
    start = (np.arange(docs.size) - np.repeat(np.cumsum(count) - count, count)) * step
    at = (off[docs] + start)[:, None] + np.arange(CHUNK)
    out = data[np.minimum(at, max(data.size - 1, 0))] if data.size else np.zeros(at.shape, np.uint8)
    tail = np.flatnonzero(start + CHUNK > size[docs])
    out[tail] = np.where(at[tail] < off[docs[tail] + 1][:, None], out[tail], 0)
    return out, docs


@dataclass
class Network:
    """Embedding of bytes, filters over two halves of a window, their bias; weights and bias of the output."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray

    @classmethod
    def fresh(cls, filters: int = 24, width: int = 8, seed: int = 3) -> Network:
        random = np.random.RandomState(seed)
        return cls(*(x.astype(np.float32) for x in (random.randn(256, width) * 0.5, random.randn(2, STRIDE * width, filters) * 0.15, np.zeros(filters), random.randn(2 * filters) * 0.1, np.zeros(1))))

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.shift]

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest value of each filter in each chunk, at least 0, and its window."""
        n = rows.shape[0]
        x = self.embed[rows].reshape(n, WINDOWS + 1, -1)
        flat = x.reshape(n * (WINDOWS + 1), -1)
        left, right = (flat @ self.filters[k] for k in (0, 1))
        z = left.reshape(n, WINDOWS + 1, -1)[:, :-1] + right.reshape(n, WINDOWS + 1, -1)[:, 1:]
        at = z.argmax(1)
        return np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0] + self.bias, 0), at

    def largest(self, rows: np.ndarray) -> np.ndarray:
        n = rows.shape[0]
        flat = self.embed[rows].reshape(n * (WINDOWS + 1), -1)
        z = (flat @ self.filters[0]).reshape(n, WINDOWS + 1, -1)[:, :-1]
        z += (flat @ self.filters[1]).reshape(n, WINDOWS + 1, -1)[:, 1:]
        return np.maximum(z.max(1) + self.bias, 0)

    def features(self, values: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
        """The largest and the mean of the chunks' values for each of n texts; 0 without chunks."""
        f = values.shape[1]
        out = np.zeros((n, 2 * f), np.float32)
        if docs.size:
            edge = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
            out[docs[edge], :f] = np.maximum.reduceat(values, edge, axis=0)
            out[docs[edge], f:] = np.add.reduceat(values, edge, axis=0) / np.diff(np.r_[edge, docs.size])[:, None]
        return out

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features.astype(np.float64) @ self.out.astype(np.float64) + float(self.shift[0]), -30, 30)))

    def score(self, rows: W.Slice, block: int = 256) -> np.ndarray:
        cut, docs = chunks(rows.data, rows.off)
        values = [self.largest(cut[i : i + block]) for i in range(0, docs.size, block)]
        return self.probability(self.features(np.concatenate(values) if values else np.zeros((0, self.bias.size), np.float32), docs, rows.n))

    def gradients(self, cut: np.ndarray, docs: np.ndarray, target: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted mean cross-entropy; through max-pooling only the winning windows count."""
        n, f = target.size, self.bias.size
        values, at = self.pooled(cut)
        features = self.features(values, docs, n)
        error = ((self.probability(features) - target) * weight / n).astype(np.float32)
        back = error[:, None] * self.out[None, :]
        count = np.bincount(docs, minlength=n)
        g = back[docs, f:] / count[docs][:, None]
        best = np.zeros((n, f), np.int64)
        order = np.argsort(values, axis=0, kind="stable")
        for k in range(f):
            best[docs[order[:, k]], k] = order[:, k]
        g[best[docs, :], np.arange(f)] += np.where(best[docs] == np.arange(docs.size)[:, None], back[docs, :f], 0)
        g *= values > 0
        place = at * STRIDE
        window = cut[np.arange(docs.size)[:, None, None], place[:, :, None] + np.arange(WIDTH)]
        x = self.embed[window].reshape(docs.size, f, -1)
        d_filters = np.einsum("nf,nfk->kf", g, x).reshape(self.filters.shape)
        full = self.filters.reshape(-1, f)
        d_x = (g[:, :, None] * full.T[None]).reshape(-1, self.embed.shape[1])
        d_embed = np.stack([np.bincount(window.ravel(), d_x[:, k], 256) for k in range(self.embed.shape[1])], 1)
        return [d_embed.astype(np.float32), d_filters, g.sum(0), features.T @ error, error.sum(keepdims=True)]


def train(cut: np.ndarray, docs: np.ndarray, target: np.ndarray, steps: int = 600, batch: int = 64, rate: float = 0.01, seed: int = 5) -> Network:
    """About so many steps of Adam over shuffled documents; both classes weigh alike; docs ascends."""
    net, random = Network.fresh(), np.random.RandomState(seed)
    m, v, step = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()], 0
    ptr = np.searchsorted(docs, np.arange(target.size + 1))
    share = np.bincount(target.astype(np.int64), minlength=2) / max(target.size, 1)
    weight = np.where(target > 0, 0.5 / max(share[1], 1e-9), 0.5 / max(share[0], 1e-9))
    epochs = -(-steps // -(-target.size // batch))
    for epoch in range(epochs):
        order = random.permutation(target.size)
        for i in range(0, order.size, batch):
            some = order[i : i + batch]
            rows = np.concatenate([np.arange(ptr[d], ptr[d + 1]) for d in some])
            of = np.repeat(np.arange(some.size), np.diff(ptr)[some])
            if not rows.size:
                continue
            step += 1
            now = rate * (1 - epoch / epochs)
            for p, g, a, b in zip(net.parameters(), net.gradients(cut[rows], of, target[some], weight[some]), m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= (now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, training: Column, sample: int = 2000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """Trains on at most `sample` documents of each class, taken in the order of a hash of their id.

    labels: one label for an id (the larger if it has several); of rows that share an id the first text
    counts. The sampled texts go to the driver whole. Without labelled documents the network is untrained.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    marks = marks.where(training)
    order = F.xxhash64(F.lit(11), F.col(id_col))
    picked = marks.where("label = 1").orderBy(order, id_col).limit(sample).unionByName(marks.where("label = 0").orderBy(order, id_col).limit(sample))

    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("text"))
    joined = texts.join(F.broadcast(picked), id_col).select(F.col(id_col).cast("long").alias("doc_id"), "label", "text")  # picked: 2 * sample rows at most
    found = joined.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text")).toPandas().sort_values("doc_id")
    if found.empty:
        return Network.fresh()
    texts = [x or b"" for x in found["text"]]
    cut, of = chunks(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(x) for x in texts])])
    return train(cut, of, found["label"].to_numpy().astype(np.float64))


def classify(docs: DataFrame, network: Network, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (probability of label 1), predicted (1 if score >= threshold).

    Null and empty texts get the score of a text without chunks. Repeated rows get equal scores;
    other columns are dropped; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [network.score(rows) for rows in W.slices(batch.column(1))]
            score = np.concatenate(scores or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return picked.mapInArrow(run, "doc_id long, score double, predicted int")
