"""Language-model scoring with a causal self-attention model in numpy.

Words are cut into the subword ids of a public vocabulary; an end id closes each text. The model
gives the class of the next id: one layer of masked attention over the ids before it corrects the
class's frequency after the last id in all training texts. An id within its class goes by its
counts after the class of the last id. Texts are scored in windows of HEAD + BODY places that
overlap by HEAD: every place is scored once, in the BODY of one window, and a batch of windows is
one masked attention.

A word that the training texts hold may also come whole. Given its first id, it is one of their
words with that id by its count, or, with the share of words that occur once among these (the
Good-Turing estimate of what is unseen), spelled id by id up to the next beginning. Summed over all
words this is a probability.

Texts are packed once, in blocks by bytes: a block's distinct words with their ids, and each text as
numbers of them. All that follows reads the blocks: counts, training, and the word counts behind
the unigram base, for which a block sends each distinct word once and gets its count in the whole
corpus back. So no vocabulary is broadcast and no row is made for a single word.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from krylith.llm import graphs
from krylith.llm import words as W
from krylith.llm.quality_rules import Pieces, expand, pieces
from krylith.llm.tables import Scratch

HEAD, BODY = 8, 40
SPAN = HEAD + BODY
#: The first BEGINS classes hold ids that begin a word, and the end; the others those inside of words.
CLASSES, BEGINS, WIDTH = 64, 32, 16
#: Bytes of text in a block, and worked on at a time; one longer text is a block of its own.
BLOCK, SLICE = 8 << 20, 1 << 20
#: Keys beside the subword ids in what tally gives: training words, training texts.
WORDS, TEXTS = -1, -2


@dataclass
class Classes:
    """The class of each id, by its frequency in all training texts. Ids beyond the pieces: end, begin."""

    of: np.ndarray

    @classmethod
    def from_counts(cls, counts: np.ndarray, begins: np.ndarray) -> Classes:
        """The most frequent ids have classes of their own; the others share classes of like mass."""
        of = np.empty(counts.size, np.int64)
        for some, low, high in ((np.flatnonzero(begins), 0, BEGINS), (np.flatnonzero(~begins), BEGINS, CLASSES)):
            order = some[np.argsort(-counts[some], kind="stable")]
            alone = (high - low) // 2
            of[order[:alone]] = low + np.arange(min(alone, order.size))
            rest = np.cumsum(counts[order[alone:]] + 0.1)
            if rest.size:
                of[order[alone:]] = low + alone + np.minimum((rest / rest[-1] * (high - low - alone)).astype(np.int64), high - low - alone - 1)
        return cls(of)


@dataclass
class Statistics:
    """From all training texts, as logs: class frequencies after each id; the share of each id in its class after each class.

    Of the words that begin with an id: their number, and the shares that are unseen and seen.
    """

    prior: np.ndarray
    inside: np.ndarray
    mass: np.ndarray
    unseen: np.ndarray
    seen: np.ndarray

    @classmethod
    def from_counts(cls, counts: np.ndarray, after: np.ndarray, before: np.ndarray, once: np.ndarray, of: np.ndarray) -> Statistics:
        """counts of ids; of classes after ids; of ids after classes, by id; of words that occur once, by first id."""
        smooth = np.bincount(of, counts + 1.0, CLASSES)
        share = smooth / smooth.sum()
        prior = np.log((after + 5 * share) / (after.sum(1, keepdims=True) + 5)).astype(np.float32)
        own = ((counts + 1.0) / smooth[of])[:, None]
        total = np.zeros((CLASSES, CLASSES))
        np.add.at(total, of, before)
        inside = np.log((before + 20 * own) / (total[of] + 20)).astype(np.float32)
        rate = (once.sum() + 1) / (counts.sum() + 1)
        unseen = np.clip((once + 4 * rate) / (counts + 4), 1e-4, 0.999)
        return cls(prior, inside, np.log(np.maximum(counts, 1)), np.log(unseen), np.log1p(-unseen))


def mask() -> np.ndarray:
    """0 where a place of the body may see a place of the window, else a large negative number."""
    return np.where(np.arange(SPAN)[None, :] <= np.arange(HEAD, SPAN)[:, None], 0, -1e9).astype(np.float32)


MASK = mask()
#: Which classes begin a word or end a text; all classes.
SPLIT = np.stack([np.arange(CLASSES) < BEGINS, np.ones(CLASSES, bool)], 1).astype(np.float32)
#: By the number of places before a text at the head of a window: what is added to scores.
MASKS = np.stack([np.minimum(MASK, np.where(np.arange(SPAN) < k, -1e9, 0)) for k in range(HEAD + 1)]).astype(np.float32)


def longest(x: np.ndarray) -> float:
    """The largest length of the rows of the last axis."""
    return float(np.sqrt(np.einsum("...i,...i->...", x, x).max(initial=0)))


class Adam:
    """Steps of Adam on weights, in place; of a table only the rows that a batch touches move.

    w's arrays become parts of one table of rows of WIDTH, `token` first, so that a step is one pass over it.
    """

    def __init__(self, w: dict[str, np.ndarray]):
        self.n, self.ids = 0, w["token"].shape[0]
        self.names = ["token", *(k for k in w if k != "token")]
        self.all = np.concatenate([w[k].reshape(-1, WIDTH) for k in self.names])
        at = 0
        for k in self.names:
            n = w[k].size // WIDTH
            w[k] = self.all[at : at + n].reshape(w[k].shape)
            at += n
        self.m, self.v = np.zeros_like(self.all), np.zeros_like(self.all)

    def step(self, grads: dict[str, np.ndarray], rows: np.ndarray, rate: float) -> None:
        """rows: those of the token table that its gradient is for."""
        self.n += 1
        up, down = 1 / (1 - 0.9**self.n), 1 / (1 - 0.99**self.n)
        at = np.concatenate([rows, np.arange(self.ids, self.all.shape[0])])
        g = np.concatenate([grads[k].reshape(-1, WIDTH) for k in self.names])
        m = np.take(self.m, at, axis=0, mode="clip")
        m *= np.float32(0.9)
        m += np.float32(0.1) * g
        v = np.take(self.v, at, axis=0, mode="clip")
        v *= np.float32(0.99)
        g *= g
        g *= np.float32(0.01)
        v += g
        self.m[at], self.v[at] = m, v
        v *= np.float32(down)
        np.sqrt(v, out=v)
        v += np.float32(1e-8)
        m *= np.float32(rate * up)
        m /= v
        self.all[at] -= m


def forward(g: graphs.Graph) -> dict[str, str]:
    """The model up to the scores of the classes, from what fed() gives. As query meets key, and value mix, in products only, these are taken first."""
    r = {k: g.input(k, *shape) for k, shape in {"place": (SPAN, WIDTH), "pair": (WIDTH, WIDTH), "through": (WIDTH, WIDTH), "out": (WIDTH, CLASSES)}.items()}
    r["x"] = g.add("Add", g.add("Gather", g.input("table", "rows", WIDTH), g.input("at", "n", SPAN, kind=np.int32)), "place")
    xq = g.add("Slice", r["x"], *(g.constant(np.array([k], np.int64)) for k in (HEAD, SPAN, 1)))
    r["q"], r["xq"] = g.add("MatMul", xq, "pair"), g.shaped(xq, -1, WIDTH)
    s = g.add("Add", g.add("FusedMatMul", r["q"], r["x"], transB=1), g.add("Gather", g.constant(MASKS), g.input("blank", "n", kind=np.int32)))
    r["a"] = g.add("Softmax", s, axis=-1)
    r["o"] = g.shaped(g.add("MatMul", r["a"], r["x"]), -1, WIDTH)
    r["h"] = g.add("Gemm", r["o"], "through", r["xq"])
    r["z"] = g.add("Gemm", r["h"], "out", g.add("Gather", g.input("prior", "rows", CLASSES), g.input("body", "places", kind=np.int32)))
    return r


@lru_cache
def learning() -> graphs.onnxruntime.InferenceSession:
    """Gradients of the mean loss. goal: classes; weight, wide: of each place, the latter WIDTH times; rest: out the other way; kinds: the classes of table's rows."""
    g = graphs.Graph()
    r = forward(g)
    column = lambda t: g.shaped(t, -1, 1)
    goal, rest = g.input("goal", "places", kind=np.int32), g.input("rest", CLASSES, WIDTH)
    weight, wide = g.input("weight", "places", 1), g.input("wide", "places", WIDTH)
    p = g.add("Softmax", r["z"], axis=-1)
    dh = g.add("Mul", g.add("Sub", g.add("MatMul", p, rest), g.add("Gather", rest, goal)), wide)
    do = g.add("FusedMatMul", dh, "through", transB=1)
    less = g.shaped(g.add("ReduceSum", g.add("Mul", do, r["o"]), g.constant(np.array([1], np.int64)), keepdims=1), -1, BODY, 1)
    do3 = g.shaped(do, -1, BODY, WIDTH)
    da = g.add("Mul", r["a"], g.add("Sub", g.add("FusedMatMul", do3, r["x"], transB=1), less))
    dq = g.shaped(g.add("MatMul", da, r["x"]), -1, WIDTH)
    dx = g.add("Add", g.add("FusedMatMul", r["a"], do3, transA=1), g.add("FusedMatMul", da, r["q"], transA=1))
    dxq = g.add("Gemm", dq, "pair", dh, transB=1)
    # by rows of the table, then by class
    at, body = (column(g.add("Cast", t, to=7)) for t in ("at", "body"))
    token = g.add("ScatterND", g.input("none", "rows", WIDTH), at, g.shaped(dx, -1, WIDTH), reduction="add")
    token = g.add("ScatterND", token, body, dxq, reduction="add")
    group = g.add("ScatterND", g.constant(np.zeros((CLASSES, WIDTH), np.float32)), g.input("kinds", "rows", 1, kind=np.int64), token, reduction="add")
    h = g.add("Concat", g.add("Mul", r["h"], wide), weight, axis=1)
    hit = g.add("ScatterND", g.constant(np.zeros((CLASSES, WIDTH + 1), np.float32)), column(g.add("Cast", goal, to=7)), h, reduction="add")
    first, square = g.constant(np.array([0], np.int64)), (WIDTH, WIDTH)
    place, late = g.add("ReduceSum", dx, first, keepdims=0), g.add("ReduceSum", g.shaped(dxq, -1, BODY, WIDTH), first, keepdims=0)
    return g.session(
        token=(token, ("rows", WIDTH)), group=(group, (CLASSES, WIDTH)), early=(place, (SPAN, WIDTH)), late=(late, (BODY, WIDTH)),
        d_pair=(g.add("Gemm", r["xq"], dq, transA=1), square), d_through=(g.add("Gemm", r["o"], dh, transA=1), square),
        all=(g.add("Gemm", h, p, transA=1), (WIDTH + 1, CLASSES)), hit=(hit, (CLASSES, WIDTH + 1)),
    )


@lru_cache
def scoring() -> graphs.onnxruntime.InferenceSession:
    """Of each place: the score of the goal, a class; the sums of the exponentials of the scores of all classes, and of those that begin a word or end a text."""
    g = graphs.Graph()
    z = forward(g)["z"]
    hit = g.add("GatherElements", z, g.input("goal", "places", 1, kind=np.int32), axis=1)
    total = g.add("MatMul", g.add("Exp", z), g.constant(SPLIT))
    return g.session(hit=(hit, ("places", 1)), sums=(total, ("places", 2)))


class Attention:
    """One masked attention layer with a residual path; weights are trained by Adam."""

    NAMES = ("token", "group", "place", "query", "key", "value", "mix", "out", "bias")

    def __init__(self, classes: Classes, statistics: Statistics, seed: int = 9):
        random = np.random.RandomState(seed)
        self.classes, self.statistics = classes, statistics
        shapes = {"token": (classes.of.size, WIDTH, 0), "group": (CLASSES, WIDTH, 0.5), "place": (SPAN, WIDTH, 0.1), "query": (WIDTH, WIDTH, 0.25), "key": (WIDTH, WIDTH, 0.25), "value": (WIDTH, WIDTH, 0.25), "mix": (WIDTH, WIDTH, 0.25), "out": (WIDTH, CLASSES, 0.05), "bias": (1, CLASSES, 0)}
        self.w = {k: (random.randn(a, b) * s).astype(np.float32) for k, (a, b, s) in shapes.items()}

    def fed(self, table: np.ndarray, prior: np.ndarray, at: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
        """What both graphs take. table: embeddings; prior: with the bias; at: which of their rows are those of ids."""
        w, at = self.w, at.astype(np.int32, copy=False)
        blank = (ids[:, :HEAD] < 0).sum(1, dtype=np.int32)
        pair = w["query"] @ w["key"].T * np.float32(1 / np.sqrt(WIDTH))
        return {"place": w["place"], "pair": pair, "through": w["value"] @ w["mix"], "out": w["out"], "table": table, "at": at, "blank": blank, "prior": prior, "body": at[:, HEAD:].ravel()}

    def learned(self, ids: np.ndarray, goal: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """The gradients of gradients() and their rows, by onnxruntime where it is installed."""
        if not graphs.onnxruntime:
            return self.gradients(ids, goal)[1:]
        w, safe = self.w, np.maximum(ids, 0)
        seen, number = np.zeros(self.classes.of.size, bool), np.empty(self.classes.of.size, np.int32)
        seen[safe] = True
        rows = np.flatnonzero(seen)
        number[rows] = np.arange(rows.size, dtype=np.int32)
        take = lambda t, at: np.take(t, at, axis=0, mode="clip")
        kinds, goal = self.classes.of[rows], goal.ravel()
        weight = (goal >= 0).astype(np.float32)
        weight /= max(float(weight.sum()), 1)
        prior = take(self.statistics.prior, rows)
        prior += w["bias"]
        feed = self.fed(take(w["token"], rows) + take(w["group"], kinds), prior, take(number, safe), ids)
        feed |= {"goal": np.maximum(goal, 0).astype(np.int32, copy=False), "weight": weight[:, None], "wide": np.repeat(weight, WIDTH).reshape(-1, WIDTH), "rest": w["out"].T.copy(), "none": np.zeros((rows.size, WIDTH), np.float32), "kinds": kinds[:, None]}
        token, group, place, late, pair, through, last, hit = learning().run(["token", "group", "early", "late", "d_pair", "d_through", "all", "hit"], feed)
        place[HEAD:] += late
        last -= hit.T
        pair *= np.float32(1 / np.sqrt(WIDTH))
        grads = {"token": token, "group": group, "place": place, "query": pair @ w["key"], "key": pair.T @ w["query"], "value": through @ w["mix"].T, "mix": w["value"].T @ through, "out": last[:WIDTH], "bias": last[WIDTH:]}
        return grads, rows

    def gradients(self, ids: np.ndarray, goal: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """ids: (n, SPAN), -1 before a text; goal: (n, BODY) classes, -1 for none. Mean loss, its gradients and the rows of that of token."""
        w, n, flat = self.w, ids.shape[0], lambda t: t.reshape(-1, t.shape[-1])
        safe = np.maximum(ids, 0)
        kind = np.uint16 if self.classes.of.size <= 1 << 16 else np.int64  # two bytes are sorted by radix
        order = np.argsort(safe.ravel().astype(kind), kind="stable")
        held = safe.ravel()[order]
        new = np.r_[True, held[1:] != held[:-1]]
        starts, inverse = np.flatnonzero(new), np.empty(order.size, np.int64)
        rows, inverse[order] = held[starts], np.cumsum(new) - 1
        one = lambda t: np.concatenate([t, np.ones((*t.shape[:-1], 1), np.float32)], -1)
        x = np.take(w["token"][rows] + w["group"][self.classes.of[rows]], inverse, axis=0, mode="clip").reshape(*ids.shape, WIDTH)
        x += w["place"]
        xq = np.ascontiguousarray(x[:, HEAD:])
        scale = np.float32(1 / np.sqrt(WIDTH))
        q, k, v = (flat(t) @ m for t, m in ((xq, w["query"] * scale), (x, w["key"]), (x, w["value"])))
        q, k, v = q.reshape(n, BODY, WIDTH), k.reshape(n, SPAN, WIDTH), one(v.reshape(n, SPAN, WIDTH))
        a = q @ k.transpose(0, 2, 1)
        a += MASK
        blank = ids[:, :HEAD] < 0
        if blank.any():
            a[:, :, :HEAD] += np.where(blank, np.float32(-1e9), np.float32(0))[:, None, :]
        # exponentials stay undivided: their sums, a column of what v's ones give, divide what is made of them
        if longest(q) * longest(k) > 50:
            a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
        o = a @ v
        share = 1 / o[:, :, WIDTH:]
        o = o[:, :, :WIDTH] * share
        h = one(flat(xq) + flat(o) @ w["mix"])
        out = np.concatenate([w["out"], w["bias"]])
        p = h @ out
        p += np.take(self.statistics.prior, safe[:, HEAD:].ravel(), axis=0, mode="clip")
        if longest(h) * longest(out.T) > 50:
            p -= p.max(-1, keepdims=True)
        np.exp(p, out=p)
        total = p @ np.ones(CLASSES, np.float32)
        goal = goal.ravel()
        real = goal >= 0
        at, weight = np.flatnonzero(real), np.float32(1 / max(int(real.sum()), 1))
        loss = -np.log(np.maximum(p[at, goal[at]] / total[at], 1e-30)).mean()
        p *= (real * weight / total).astype(np.float32)[:, None]
        p[at, goal[at]] -= weight
        dh = p @ w["out"].T
        do = (dh @ w["mix"].T).reshape(n, BODY, WIDTH)
        less = -np.einsum("nij,nij->ni", do, o)[:, :, None]
        do = np.concatenate([do, less], -1) * share
        da = do @ v.transpose(0, 2, 1)
        da *= a
        dv = flat(a.transpose(0, 2, 1) @ do[:, :, :WIDTH])
        dq, dk = flat(da @ k) * scale, flat(da.transpose(0, 2, 1) @ q)
        dx = (dk @ w["key"].T + dv @ w["value"].T).reshape(n, SPAN, WIDTH)
        dx[:, HEAD:] += (dh + dq @ w["query"].T).reshape(n, BODY, WIDTH)
        if blank.any():
            dx[ids < 0] = 0
        token = np.add.reduceat(np.take(flat(dx), order, axis=0, mode="clip"), starts, axis=0)
        group = (self.classes.of[rows] == np.arange(CLASSES)[:, None]).astype(np.float32) @ token
        last = h.T @ p
        grads = {"token": token, "group": group, "place": dx.sum(0), "query": flat(xq).T @ dq, "key": flat(x).T @ dk, "value": flat(x).T @ dv, "mix": flat(o).T @ dh, "out": last[:WIDTH], "bias": last[WIDTH:]}
        return loss, grads, rows

    def flat(self) -> np.ndarray:
        """A copy of all weights in rows of WIDTH, those of the ids first."""
        return np.concatenate([self.w[k].reshape(-1, WIDTH) for k in self.NAMES])

    def moved(self, rows: np.ndarray) -> None:
        """Sets all weights from rows as flat() gives them."""
        at = 0
        for k in self.NAMES:
            n = self.w[k].size // WIDTH
            self.w[k] = rows[at : at + n].reshape(self.w[k].shape).astype(np.float32)
            at += n

    def passed(self, parts: Iterator[tuple[np.ndarray, np.ndarray]], batch: int = 64, rate: float = 0.005, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """One step for each batch of the windows (ids, goal) of all parts, each window once.

        Gives how far each row of flat() moved, and the places that it was learned from.
        """
        random, adam, before = np.random.RandomState(seed), Adam(self.w), self.flat()
        seen, places = np.zeros(self.classes.of.size, np.int64), 0
        for ids, goal in parts:
            order = random.permutation(ids.shape[0])
            for i in range(0, order.size, batch):
                some = order[i : i + batch]
                adam.step(*self.learned(ids[some], goal[some]), rate)
            seen += np.bincount(np.maximum(ids, 0).ravel(), minlength=seen.size) * (ids.size > 0)
            places += int((goal >= 0).sum())
        return self.flat() - before, np.r_[seen, np.full(before.shape[0] - seen.size, places)]

    def prepared(self) -> Attention:
        """Folds embeddings into the projections, so scoring looks rows up where training multiplies.

        The rows: what a place asks with, what it keeps, what it is asked for, and what it gives, whose
        last 1 sums the attention weights.
        """
        w = self.w
        x = w["token"] + w["group"][self.classes.of]
        scale = np.float32(1 / np.sqrt(WIDTH))
        self.embeddings = x
        sides = lambda t: [t @ w["query"] * scale, t, t @ w["key"], np.hstack([t @ w["value"] @ w["mix"], np.zeros((t.shape[0], 1), np.float32)])]
        self.rows, self.place_rows = sides(x), sides(w["place"])
        self.place_rows = [t[HEAD:] if k < 2 else t for k, t in enumerate(self.place_rows)]
        self.place_rows[3][:, -1] = 1
        self.statistics = replace(self.statistics, prior=(self.statistics.prior + w["bias"]).astype(np.float32))
        self.reach = float(np.linalg.norm(w["out"], axis=0).max()), float(np.abs(w["bias"]).max())
        self.mask = mask()
        self.space: dict[str, np.ndarray] = {}
        return self

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array whose memory is used again in the next batch."""
        if name not in self.space or self.space[name].shape[0] < shape[0]:
            self.space[name] = np.empty(shape, np.float32)
        return self.space[name][: shape[0]]

    def places(self, ids: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of each goal class (0 where goal is -1), and that a word or the end begins.

        Maxima are taken off before exponentials only where some value could leave their range: a
        place always sees itself, and some class has a prior of at least 1 / CLASSES.
        """
        n, safe = ids.shape[0], np.maximum(ids, 0)
        if graphs.onnxruntime:
            feed = self.fed(self.embeddings, self.statistics.prior, safe, ids)
            hit, sums = scoring().run(["hit", "sums"], feed | {"goal": np.maximum(goal, 0).astype(np.int32, copy=False).reshape(-1, 1)})
            begins, total = sums.T
            if 1e-20 < total.min(initial=1) and total.max(initial=1) < 1e30:  # else an exponential may have left its range
                log_total = np.log(total)
                return np.where(goal.ravel() >= 0, hit[:, 0] - log_total, 0), np.log(np.maximum(begins, 1e-30)) - log_total
        body = np.ascontiguousarray(safe[:, HEAD:])
        got = []
        for k, (table, place) in enumerate(zip(self.rows, self.place_rows)):
            at = body if k < 2 else safe
            rows = self.room(f"row{k}", n, at.shape[1], table.shape[1])
            np.take(table, at, axis=0, out=rows, mode="clip")
            rows += place
            got.append(rows)
        asks, keeps, asked, gives = got
        s = np.matmul(asks, asked.transpose(0, 2, 1), out=self.room("s", n, BODY, SPAN))
        s += self.mask
        blank = ids[:, :HEAD] < 0
        if blank.any():
            s[:, :, :HEAD] += np.where(blank, np.float32(-1e9), np.float32(0))[:, None, :]
        own = np.arange(BODY)
        if max(s.max(initial=0), -s[:, own, own + HEAD].min(initial=0)) > 50:
            s -= s.max(2, keepdims=True)
        np.exp(s, out=s)
        h = np.matmul(s, gives, out=self.room("h", n, BODY, WIDTH + 1))
        keeps += np.divide(h[:, :, :WIDTH], h[:, :, WIDTH:], out=asks)
        h = keeps.reshape(-1, WIDTH)
        z = np.matmul(h, self.w["out"], out=self.room("z", n * BODY, CLASSES))
        z += np.take(self.statistics.prior, body.ravel(), axis=0, out=self.room("prior", n * BODY, CLASSES), mode="clip")
        if np.sqrt(np.einsum("ij,ij->i", h, h).max(initial=0)) * self.reach[0] + self.reach[1] > 50:
            z -= z.max(1, keepdims=True)
        goal = goal.ravel()
        hit = z[np.arange(goal.size), np.maximum(goal, 0)]
        np.exp(z, out=z)
        begins, total = (z @ SPLIT).T
        log_total = np.log(total)
        return np.where(goal >= 0, hit - log_total, 0), np.log(np.maximum(begins, 1e-30)) - log_total

    def log_probability(self, ids: np.ndarray, ptr: np.ndarray, first_id: np.ndarray, counts: np.ndarray, word_ptr: np.ndarray, block: int = 128) -> np.ndarray:
        """Natural log probability of each text.

        Text i has the ids ptr[i]:ptr[i+1], the last being the end, and the words word_ptr[i]:word_ptr[i+1];
        a word begins at place first_id and occurs counts times in the training texts.
        """
        first, docs, inputs, goals = windows(ids, ptr, self.classes.of.size - 1)
        of, st, hit, begins = self.classes.of, self.statistics, np.zeros(ids.size), np.zeros(ids.size)
        for i in range(0, docs.size, block):
            at = first[i : i + block, None] + np.arange(SPAN) - HEAD
            low, high = ptr[docs[i : i + block]][:, None], ptr[docs[i : i + block] + 1][:, None]
            seen = np.where(at < low, -1, inputs[np.minimum(np.maximum(at, 0), inputs.size - 1)])
            body = at[:, HEAD:]
            real = (body < high).ravel()
            place = np.minimum(body, goals.size - 1)
            a, b = self.places(seen, np.where(body < high, of[goals[place]], -1))
            hit[place.ravel()[real]], begins[place.ravel()[real]] = a[real], b[real]
        ends = ptr[1:] - 1
        each = hit + st.inside[ids, of[inputs]]
        total = np.r_[0, np.cumsum(each)]
        past = np.r_[first_id[1:], 0]
        past[word_ptr[1:][np.diff(word_ptr) > 0] - 1] = ends[np.diff(word_ptr) > 0]
        opening, lead = each[first_id] - begins[first_id], ids[first_id]
        spelled = st.unseen[lead] + total[past] - total[first_id + 1] + begins[past]
        whole = np.where(counts > 0, st.seen[lead] + np.log(np.maximum(counts, 1)) - st.mass[lead], -np.inf)
        return W.sums(opening + np.minimum(np.logaddexp(spelled, whole), 0), word_ptr) + each[ends] - begins[ends]


def windows(ids: np.ndarray, ptr: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First place of the body and text of each window; the input before each place; the goal at each place."""
    inputs = np.empty_like(ids)
    inputs[1:] = ids[:-1]
    inputs[ptr[:-1][np.diff(ptr) > 0]] = begin
    count = -(-np.diff(ptr) // BODY)
    docs = np.repeat(np.arange(ptr.size - 1), count)
    return ptr[docs] + (np.arange(docs.size) - np.repeat(np.cumsum(count) - count, count)) * BODY, docs, inputs, ids


def cut_windows(ids: np.ndarray, ptr: np.ndarray, begin: int, every: int = 1, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Windows as matrices of inputs (-1 before a text) and goals (-1 after it): of each text number turn, turn + every and so on, or all."""
    first, docs, inputs, goals = windows(ids, ptr, begin)
    if every > 1:
        mine = (first - ptr[docs]) // BODY % every == turn
        first, docs = first[mine], docs[mine]
    at = first[:, None] + np.arange(SPAN) - HEAD
    body = at[:, HEAD:]
    goal = np.where(body < ptr[docs + 1][:, None], goals[np.minimum(body, max(goals.size - 1, 0))], -1)
    return np.where(at < ptr[docs][:, None], -1, inputs[np.minimum(np.maximum(at, 0), max(inputs.size - 1, 0))]), goal


class Subwords:
    """The ids of whole texts, ends included, and the hashes of their words."""

    def __init__(self, vocabulary: str):
        self.model: Pieces = pieces(vocabulary)
        self.end, self.begin = self.model.size, self.model.size + 1
        self.begins = np.array([self.model.model.id_to_piece(i).startswith("\u2581") for i in range(self.model.size)] + [True, False])

    def cut(self, rows: W.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a slice, lower-cased in A-Z: hash of each distinct word; number of each word among them; number of ids of the distinct; these ids."""
        rows.data = np.where((rows.data >= 65) & (rows.data <= 90), rows.data + 32, rows.data).astype(np.uint8)
        rows.split()
        keys, first, inverse = np.unique(rows.hashes(), return_index=True, return_inverse=True)
        counts, _, ids = self.model.look(keys, rows, first)
        return keys, inverse, counts, ids


@lru_cache
def subwords(vocabulary: str) -> Subwords:
    return Subwords(vocabulary)


def laid(word: np.ndarray, word_ptr: np.ndarray, spell_n: np.ndarray, spell: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all texts, each closed by end; where each text's ids begin; where each word's do.

    word: number of each word; word_ptr: where the words of a text begin; word w has spell_n[w] ids in spell.
    """
    n = spell_n[word]
    flat = spell[expand(spell_n, word)]
    texts = word_ptr.size - 1
    size = W.sums(n, word_ptr)
    ptr = np.r_[0, np.cumsum(size + 1)]
    out = np.full(int(ptr[-1]), end, np.int32)
    out[np.arange(flat.size) + np.repeat(np.arange(texts), size)] = flat
    return out, ptr, np.cumsum(n) - n + np.repeat(np.arange(texts), np.diff(word_ptr))


#: A block: doc_id and whether it is null, number of words and whether it is a training row of each text;
#: number of each word; hash, number of occurrences in training rows and of ids of each distinct word; their ids.
FIELDS = {"doc": np.int64, "missing": np.bool_, "n_words": np.int32, "train": np.bool_, "word": np.int32, "key": np.uint64, "trained": np.int32, "spell_n": np.int32, "spell": np.int32}


def planes(values: np.ndarray, kind: type) -> bytes:
    """Values byte by byte, all lowest bytes first: small numbers then pack well."""
    return values.astype(kind).view(np.uint8).reshape(values.size, np.dtype(kind).itemsize).T.tobytes()


def pack(batches: Iterator[pa.RecordBatch], sub: Subwords, partition: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """One row for each block of about block_bytes: block and the FIELDS as planes of bytes; frequent words have low numbers."""
    held, size, block = [], 0, 0

    def flush() -> pa.RecordBatch:
        parts = {k: [h[k] for h in held] for k in held[0]}
        keys, first, inverse = np.unique(np.concatenate(parts["key"]), return_index=True, return_inverse=True)
        start = np.cumsum([0] + [k.size for k in parts["key"]])
        word = np.concatenate([inverse[a + w] for a, w in zip(start, parts["word"])])
        order = np.argsort(-np.bincount(word, minlength=keys.size), kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(order.size)
        word, first = rank[word], first[order]
        spell_n, spell = np.concatenate(parts["spell_n"]), np.concatenate(parts["spell"])
        n_words, train = np.concatenate(parts["n_words"]), np.concatenate(parts["train"])
        out = {"doc": np.concatenate(parts["doc"]), "missing": np.concatenate(parts["missing"]), "n_words": n_words, "train": train, "word": word, "key": keys[order], "trained": np.bincount(word[np.repeat(train, n_words)], minlength=keys.size), "spell_n": spell_n[first], "spell": spell[expand(spell_n, first)]}
        return pa.RecordBatch.from_arrays([pa.array([partition << 32 | block], pa.int64()), *(pa.array([planes(out[k], t)], pa.binary()) for k, t in FIELDS.items())], ["block", *FIELDS])

    for batch in batches:
        doc, train = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        ids, missing = doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_null().to_numpy(zero_copy_only=False)
        for rows in W.slices(batch.column(1), SLICE):
            keys, inverse, counts, flat = sub.cut(rows)
            here = slice(rows.at, rows.at + rows.n)
            held.append({"doc": ids[here], "missing": missing[here], "n_words": np.diff(rows.ptr), "train": train[here], "key": keys, "word": inverse, "spell_n": counts, "spell": flat})
            size += rows.data.size
            if size >= block_bytes:
                yield flush()
                held, size, block = [], 0, block + 1
    if held:
        yield flush()


def unpacked(batch: pa.RecordBatch | pa.Table, row: int, *names: str) -> list[np.ndarray]:
    found = []
    for k in names:
        kind = np.dtype(FIELDS[k])
        raw = np.frombuffer(batch.column(k)[row].as_buffer(), np.uint8)
        found.append(np.ascontiguousarray(raw.reshape(kind.itemsize, raw.size // kind.itemsize).T).view(kind).ravel())
    return found


def pieces_of(word: np.ndarray, n_words: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """The texts of a block in runs of about `most` words: which texts, their words, and where each text's begin."""
    ptr, i = np.r_[0, np.cumsum(n_words, dtype=np.int64)], 0
    while i < n_words.size:
        j = max(i + 1, int(np.searchsorted(ptr, ptr[i] + most, "right")) - 1)
        yield slice(i, j), word[ptr[i] : ptr[j]], ptr[i : j + 1] - ptr[i]
        i = j


def training_pieces(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of the training texts of packed blocks and where each text begins."""
    for batch in batches:
        for row in range(batch.num_rows):
            n_words, train, word, spell_n, spell = unpacked(batch, row, "n_words", "train", "word", "spell_n", "spell")
            for _, some, ptr in pieces_of(word[np.repeat(train, n_words)], n_words[train]):
                yield laid(some, ptr, spell_n, spell, end)[:2]


def score(docs: DataFrame, training: Column, vocabulary: str = "piece_bpe_32k.model", every: int = 2, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    training marks the rows to learn from. All statistics of ids, classes and words cover all their places.
    The attention weights learn in `rounds` rounds: in each, every partition goes over windows of all its
    training rows, and the weights move by the mean of the partitions, each weighted by the places it
    learned from (an id: where it occurs). Of each training text, the rounds take in turn every
    `every`-th window, beginning with its first; every = rounds, the default, takes all windows once. Null texts are
    empty: one end. Repeated rows count as often as they occur; null ids are rows like others.
    Without training rows N is 0 and the model is untrained. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    sub = subwords(vocabulary)
    end, begin = sub.end, sub.begin
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    packed = scratch.save(picked.mapInArrow(lambda batches: pack(batches, subwords(vocabulary), TaskContext.get().partitionId(), BLOCK), "block long, " + ", ".join(f"{k} binary" for k in FIELDS)), row_check=1)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of ids, training words and training texts of a partition."""
        n, words, texts = np.zeros(begin + 1, np.int64), 0, 0
        for batch in batches:
            for row in range(batch.num_rows):
                train, trained, spell_n, spell = unpacked(batch, row, "train", "trained", "spell_n", "spell")
                n += np.bincount(spell, np.repeat(trained, spell_n), n.size).astype(np.int64)
                words, texts = words + int(trained.sum()), texts + int(train.sum())
        n[end] += texts
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, WORDS, TEXTS], pa.int64()), pa.array(np.r_[n[some], words, texts], pa.int64())], ["key", "n"])

    # one row for each id of the vocabulary at most
    found = packed.select("train", "trained", "spell_n", "spell").mapInArrow(tally, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas().set_index("key")["n"]
    ends = int(found.get(TEXTS, 0))
    n_train = int(found.get(WORDS, 0)) + ends
    found = found[found.index >= 0]
    counts = np.zeros(begin + 1)
    counts[found.index.to_numpy(np.int64)] = found.to_numpy()
    classes = Classes.from_counts(counts, sub.begins)
    of = classes.of

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of each (id, class after it) and (class, id after it) of a partition, as numbers from 0 and from the size of a table."""
        size = (begin + 1) * CLASSES
        n = np.zeros((2, size))

        def add(before: np.ndarray, after: np.ndarray, times: np.ndarray | None) -> None:
            for k, at in enumerate((before * CLASSES + of[after], after * CLASSES + of[before])):
                n[k] += np.bincount(at, times, size)

        for batch in batches:
            for row in range(batch.num_rows):
                n_words, train, word, trained, spell_n, spell = unpacked(batch, row, "n_words", "train", "word", "trained", "spell_n", "spell")
                spell, past = spell.astype(np.int64), np.cumsum(spell_n)
                inner = np.ones(spell.size, bool)
                inner[past - spell_n] = False
                inner = np.flatnonzero(inner)
                add(spell[inner - 1], spell[inner], np.repeat(trained, spell_n)[inner])
                # between words: begin or the last id of a word, then the first id of the next or the end
                n_words, word = n_words[train], word[np.repeat(train, n_words)]
                at = np.arange(word.size) + np.repeat(np.arange(n_words.size), n_words)
                edge = np.cumsum(n_words + 1) - 1
                before, after = np.full(word.size + n_words.size, begin), np.full(word.size + n_words.size, end)
                before[at + 1] = spell[past - 1][word]
                before[edge - n_words] = begin
                after[at] = spell[past - spell_n][word]
                add(before, after, None)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n.ravel()[some].astype(np.int64))], ["key", "n"])

    tokens = packed.select("n_words", "train", "word", "spell_n", "spell")
    # two tables of one row for each id and class at most
    found = packed.select("n_words", "train", "word", "trained", "spell_n", "spell").mapInArrow(follow, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    tables = np.zeros((2, begin + 1, CLASSES), np.float32)
    tables.ravel()[found["key"].to_numpy(np.int64)] = found["n"].to_numpy()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct words of blocks: number in the block, hash, first id, occurrences in training rows."""
        for batch in batches:
            for row in range(batch.num_rows):
                key, trained, spell_n, spell = unpacked(batch, row, "key", "trained", "spell_n", "spell")
                block = np.full(key.size, batch.column("block")[row].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(np.arange(key.size), pa.int32()), pa.array(key.view(np.int64)), pa.array(spell[np.cumsum(spell_n) - spell_n], pa.int32()), pa.array(trained.astype(np.int64))], ["block", "at", "key", "lead", "n"])

    words = packed.select("block", "key", "trained", "spell_n", "spell").mapInArrow(listed, "block long, at int, key long, lead int, n long")
    known = scratch.save(words.where("n > 0").groupBy("key").agg(F.sum("n").alias("count"), F.min("lead").alias("lead")))
    # one row for each id that begins words at most
    first = known.groupBy("lead").agg(F.count("*").alias("words"), F.sum((F.col("count") == 1).cast("long")).alias("once")).toPandas()
    distinct = int(first["words"].sum()) + (ends > 0)
    once = np.zeros(begin + 1)
    once[first["lead"].to_numpy(np.int64)] = first["once"].to_numpy()
    model = Attention(classes, Statistics.from_counts(counts, *tables, once, of))

    names = [f"v{k}" for k in range(WIDTH)]
    for turn in range(rounds):
        begun = spark.sparkContext.broadcast(model)  # its size is fixed by the vocabulary

        def practise(batches: Iterator[pa.RecordBatch], turn: int = turn, begun: Broadcast = begun) -> Iterator[pa.RecordBatch]:
            """How far a partition moves each row of weights, times its places, and these."""
            model = copy.deepcopy(begun.value)

            def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for flat, ptr in training_pieces(batches, end):
                    ids, goal = cut_windows(flat, ptr, begin, every, turn * every // rounds) if every > rounds else cut_windows(flat, ptr, begin, rounds, turn)
                    yield ids, np.where(goal >= 0, of[goal], -1)

            far, places = model.passed(parts())
            some = np.flatnonzero(places)
            sums = far[some].astype(np.float64) * places[some, None]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(places[some], pa.int64()), *(pa.array(c) for c in sums.T.copy())], ["key", "n", *names])

        # one row for each row of weights at most
        far = tokens.mapInArrow(practise, "key long, n long, " + ", ".join(f"{k} double" for k in names)).groupBy("key").agg(F.sum("n").alias("n"), *(F.sum(k).alias(k) for k in names)).toPandas()
        rows = model.flat()
        rows[far["key"].to_numpy(np.int64)] += far[names].to_numpy() / far[["n"]].to_numpy()
        model.moved(rows)
        begun.unpersist()
    sent = spark.sparkContext.broadcast(model.prepared())
    unit = np.log10(n_train + distinct + 1)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        model, out = sent.value, {"doc_id": [], "n_tokens": [], "n_known": [], "base_score": [], "score": []}
        for row in range(left.num_rows):
            doc, missing, n_words, word, spell_n, spell = unpacked(left, row, "doc", "missing", "n_words", "word", "spell_n", "spell")
            count = np.zeros(spell_n.size, np.int64)
            count[right.column("at").to_numpy()] = right.column("count").to_numpy()
            for texts, some, word_ptr in pieces_of(word, n_words):
                ids, ptr, at_word = laid(some, word_ptr, spell_n, spell, end)
                c, n = count[some], np.diff(word_ptr) + 1
                out["doc_id"].append(pa.array(doc[texts], pa.int64(), mask=missing[texts]))
                out["n_tokens"].append(pa.array(n, pa.int64()))
                out["n_known"].append(pa.array(W.sums(c > 0, word_ptr) + (ends > 0), pa.int64()))
                out["base_score"].append(pa.array(W.sums(np.log10(c + 1.0), word_ptr) + np.log10(ends + 1.0) - n * unit))
                out["score"].append(pa.array(model.log_probability(ids, ptr, at_word, c, word_ptr) / np.log(10)))
        columns = {k: pa.chunked_array(v, pa.float64() if "score" in k else pa.int64()) for k, v in out.items()}
        columns["train_tokens"] = pa.array(np.full(len(columns["doc_id"]), n_train), pa.int64())
        return pa.table({k: columns[k] for k in ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")})

    back = words.join(known.select("key", "count"), "key").select("block", "at", "count")
    texts = packed.select("block", "doc", "missing", "n_words", "word", "spell_n", "spell")
    return texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(finish, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
