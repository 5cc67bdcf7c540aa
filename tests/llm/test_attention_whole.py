"""The language model learns from all training rows, and scores as a plain forward pass does."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from krylith.llm import attention_lm as A
from tests.llm.test_operators import spark  # noqa: F401

TEXTS = [f"the {w} ran away and the {w} came home" for w in ["dog", "cat", "horse", "mouse", "bird", "snake"]]


def spelled(sub, text):
    """Words of a text, each with its ids."""
    return [(w, sub.model.model.encode(w)) for w in (text or "").lower().split()]


def test_learns_from_all_rows(spark, monkeypatch):  # noqa: F811
    counted, moved = [], []
    keep, move = A.Classes.from_counts.__func__, A.Attention.moved
    monkeypatch.setattr(A.Classes, "from_counts", classmethod(lambda cls, counts, begins: counted.append(counts.copy()) or keep(cls, counts, begins)))
    monkeypatch.setattr(A.Attention, "moved", lambda self, rows: moved.append(rows - self.flat()) or move(self, rows))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert A.score(docs, F.col("doc_id") < 5, every=1, rounds=1).count() == 6
    sub = A.subwords("piece_bpe_32k.model")
    ids = [[i for _, word in spelled(sub, t) for i in word] + [sub.end] for t in TEXTS]
    assert (counted[0] == np.bincount(np.concatenate(ids[:5]), minlength=sub.begin + 1)).all()
    learned = {x for t in ids[:5] for x in t} - {sub.end} | {sub.begin}
    assert set(np.flatnonzero(np.abs(moved[0][: sub.begin + 1]).sum(1))) == learned


def test_learns_from_all_windows(spark, monkeypatch):  # noqa: F811
    moved, move = [], A.Attention.moved
    monkeypatch.setattr(A.Attention, "moved", lambda self, rows: moved.append(np.abs(rows - self.flat()).sum(1)) or move(self, rows))
    names = "river stone cloud table music winter garden silver window paper bread horse".split()
    text = " ".join(w for w in names for _ in range(60))
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    assert A.score(docs, F.lit(True)).count() == 1
    sub = A.subwords("piece_bpe_32k.model")
    ids = {i for _, word in spelled(sub, text) for i in word}
    assert ids <= set(np.flatnonzero(sum(moved)[: sub.end]))


def plain(model, sub, words, known):
    """Log probability of a text, place by place; known: occurrences of words in training texts."""
    st, of, w = model.statistics, model.classes.of, model.w
    ids, begins_at, ends_at = [], [], []
    for _, word in words:
        begins_at.append(len(ids))
        ids += word
        ends_at.append(len(ids))
    ids.append(sub.end)
    inputs = [sub.begin, *ids[:-1]]

    def row(k):
        """Log probabilities of the classes at place k."""
        start = k // A.BODY * A.BODY - A.HEAD
        see = [j for j in range(max(start, 0), k + 1)]
        x = np.array([w["token"][inputs[j]] + w["group"][of[inputs[j]]] + w["place"][j - start] for j in see], float)
        s = (x[-1] @ w["query"]) @ (x @ w["key"]).T / math.sqrt(A.WIDTH)
        a = np.exp(s - s.max())
        h = x[-1] + (a / a.sum()) @ (x @ w["value"]) @ w["mix"]
        z = h @ w["out"] + w["bias"][0] + st.prior[inputs[k]]
        return z - z.max() - np.log(np.exp(z - z.max()).sum())

    def step(k):
        return row(k)[of[ids[k]]] + float(st.inside[ids[k], of[inputs[k]]])

    def opens(k):
        return np.log(np.exp(row(k)[: A.BEGINS]).sum())

    total = step(len(ids) - 1) - opens(len(ids) - 1)
    for (word, _), a, b in zip(words, begins_at, ends_at):
        lead = ids[a]
        later = st.unseen[lead] + sum(step(k) for k in range(a + 1, b)) + opens(b)
        whole = st.seen[lead] + math.log(known[word]) - st.mass[lead] if known[word] else -math.inf
        total += step(a) - opens(a) + np.logaddexp(later, whole)
    return total / math.log(10)


def test_score_is_a_plain_forward_pass(spark, monkeypatch):  # noqa: F811
    made = []
    prepare = A.Attention.prepared
    monkeypatch.setattr(A.Attention, "prepared", lambda self: made.append(A.copy.deepcopy(self)) or prepare(self))
    texts = [*TEXTS, "", None, "Qwyzk the DOG", " ".join(TEXTS * 3)]
    docs = spark.createDataFrame([(None if i == 1 else i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, block string")
    got = {r["doc_id"]: r for r in A.score(docs, F.coalesce(F.col("doc_id"), F.lit(1)) < 5).collect()}
    assert len(got) == len(texts)
    sub = A.subwords("piece_bpe_32k.model")
    known = collections.Counter(w for t in texts[:5] for w, _ in spelled(sub, t))
    for i, text in enumerate(texts):
        assert got[None if i == 1 else i]["score"] == pytest.approx(plain(made[0], sub, spelled(sub, text), known), rel=1e-4, abs=1e-4)


@pytest.mark.parametrize("size", [0.3, 0.7])
def test_gradients_are_slopes_of_the_loss(size):
    """By differences, with places before a text, goals left out, and scores whose exponentials need their maxima off."""
    rand, of = np.random.RandomState(1), np.arange(90) % A.CLASSES
    counts = rand.randint(1, 30, of.size).astype(float)
    st = A.Statistics.from_counts(counts, rand.rand(of.size, A.CLASSES), rand.rand(of.size, A.CLASSES), np.minimum(counts, 3), of)
    assert not hasattr(A, "softmax")  # exponentials are divided only in what is made of them
    model = A.Attention(A.Classes(of), st)
    model.w = {k: (rand.randn(*x.shape) * size).astype(np.float32) for k, x in model.w.items()}
    ids, goal = rand.randint(0, 90, (5, A.SPAN)), rand.randint(0, A.CLASSES, (5, A.BODY))
    ids[0, : A.HEAD], goal[1, 7:] = -1, -1
    loss, grads, rows = model.gradients(ids, goal)

    def wide(w):
        """The same loss in doubles."""
        x = (w["token"] + w["group"][of])[np.maximum(ids, 0)] + w["place"]
        s = np.einsum("nid,njd->nij", x[:, A.HEAD :] @ w["query"], x @ w["key"]) / math.sqrt(A.WIDTH) + A.mask() + np.where(ids < 0, -1e9, 0)[:, None, :]
        a = np.exp(s - s.max(2, keepdims=True))
        h = x[:, A.HEAD :] + a / a.sum(2, keepdims=True) @ (x @ w["value"]) @ w["mix"]
        z = h @ w["out"] + w["bias"] + st.prior[np.maximum(ids, 0)[:, A.HEAD :]]
        z = z - z.max(2, keepdims=True)
        z = z - np.log(np.exp(z).sum(2, keepdims=True))
        return -np.take_along_axis(z, np.maximum(goal, 0)[:, :, None], 2)[:, :, 0][goal >= 0].mean()

    w = {k: x.astype(float) for k, x in model.w.items()}
    if size < 0.5:  # beyond, the loss reported is held at that of 1e-30
        assert loss == pytest.approx(wide(w), rel=1e-4)
    for k, g in grads.items():
        way = rand.randn(*g.shape)
        step = np.zeros_like(w[k])
        step[rows if k == "token" else slice(None)] = way * 1e-6
        slope = (wide(w | {k: w[k] + step}) - wide(w | {k: w[k] - step})) / 2e-6
        assert slope == pytest.approx(float((g * way).sum()), rel=5e-3, abs=5e-4 * float(np.abs(g).max()) * math.sqrt(g.size))


@pytest.mark.parametrize("size", [0.3, 1.0])
def test_graphs_equal_numpy(size, monkeypatch):
    """Training and scoring by onnxruntime, with scores beyond the range of exponentials too, give what numpy gives."""
    assert A.graphs.onnxruntime, "without it op6 is right but over its time limit"
    rand, of = np.random.RandomState(2), np.arange(90) % A.CLASSES
    counts = rand.randint(1, 30, of.size).astype(float)
    st = A.Statistics.from_counts(counts, rand.rand(of.size, A.CLASSES), rand.rand(of.size, A.CLASSES), np.minimum(counts, 3), of)
    model = A.Attention(A.Classes(of), st)
    model.w = {k: (rand.randn(*x.shape) * size).astype(np.float32) for k, x in model.w.items()}
    ids, goal = rand.randint(0, 90, (7, A.SPAN)), rand.randint(0, A.CLASSES, (7, A.BODY))
    ids[0, : A.HEAD], ids[1, :3], goal[1, 7:], goal[6] = -1, -1, -1, -1
    _, grads, rows = model.gradients(ids, goal)
    found, places = model.learned(ids, goal)
    assert (places == rows).all() and found.keys() == grads.keys()
    for k, g in grads.items():
        assert np.allclose(found[k], g, rtol=1e-3, atol=2e-4 * float(np.abs(g).max())), k
    model.w["out"] *= 100 * size  # beyond the range of exponentials
    model.prepared()
    fast = model.places(ids, goal)
    monkeypatch.setattr(A.graphs, "onnxruntime", None)
    for a, b in zip(fast, model.places(ids, goal)):
        assert np.isfinite(b).all() and np.allclose(a, b, rtol=1e-4, atol=1e-3)
    assert fast[0].min() < -100
    # without onnxruntime the gradients are those of numpy
    assert all((g == model.learned(ids, goal)[0][k]).all() for k, g in model.gradients(ids, goal)[1].items())


def test_words_sum_to_one():
    """Of all words of one lead id, the known ones and the spelled rest share the probability."""
    rand, of = np.random.RandomState(0), np.arange(90) % A.CLASSES
    counts = rand.randint(1, 30, of.size).astype(float)
    st = A.Statistics.from_counts(counts, rand.rand(of.size, A.CLASSES), rand.rand(of.size, A.CLASSES), np.minimum(counts, 3), of)
    assert np.allclose(np.exp(st.unseen) + np.exp(st.seen), 1)
    for k in range(A.CLASSES):
        before = np.exp(st.inside[of == k])
        assert np.all(before.sum(0) < 1.5)


def test_empty_and_untrained(spark):  # noqa: F811
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    assert A.score(docs.limit(0), F.lit(True)).collect() == []
    rows = A.score(docs, F.lit(False)).collect()
    assert len(rows) == 3 and {r["train_tokens"] for r in rows} == {0} and all(np.isfinite(r["score"]) for r in rows)
