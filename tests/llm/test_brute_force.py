"""Verdicts, targets and orders recomputed plainly; empty tables, repeated rows and extra columns for the other operators."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from krylith.llm import language_id, quality_classifier, quality_rules
from krylith.llm.decontaminate import decontaminate
from krylith.llm.html_text import extract_text, visible_text
from krylith.llm.mixing import mix
from tests.llm.test_operators import SCHEMA, WORD, corpus, docs, empty, spark  # noqa: F401


def test_quality_verdict(docs):  # noqa: F811
    model = quality_rules.pieces("piece_bpe_32k.model").model
    for r in quality_rules.quality_rules(docs).collect():
        _, text, lang, *_ = next(c for c in corpus() if c[0] == r["doc_id"])
        text = text or ""
        ids = [i for w in WORD.findall(text) for i in model.encode(w)]
        count = collections.Counter(ids)
        entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in count.values()) if ids else 0.0
        fallback = sum(model.is_byte(i) or model.is_unknown(i) for i in ids)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r["n_tokens"], r["n_fallback"], r["n_symbols"], r["n_dup_lines"]) == (len(ids), fallback, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)))
        assert math.isclose(r["token_entropy"], entropy, abs_tol=1e-9)
        band = quality_rules.BANDS[r["band"]]
        assert r["band"] == lang or lang not in quality_rules.BANDS
        n = max(len(ids), 1)
        low = np.interp(math.log2(n), [math.log2(x) for x, _ in band.floor], [y for _, y in band.floor])
        ratio = r["word_chars"] / n
        good = (len(ids) < band.min_tokens or band.chars_low <= ratio <= band.chars_high) and fallback <= band.byte_share * n and entropy >= low
        assert r["kept"] == (good and not r["base_failed"])


def test_quality_bands_reject(spark):  # noqa: F811
    prose = "When the river rose last spring, several families carried their furniture upstairs and waited for the council to open the old mill gate, although nobody living nearby remembered how its rusty wheel had ever been turned by hand before."
    odd = "ⲁⲃⲅ ⲇⲉⲋ ⲍⲏⲑ ⲓⲕⲗ ⲙⲛⲝ ⲟⲡⲣ ⲥⲧⲩ ⲫⲭⲯ ⲱⲳⲵ ⲷⲹⲻ ⲽⲿⳁ ⳃⳅⳇ"
    rows = [(1, prose, "en", "s", 1, "x"), (2, odd, "en", "s", 1, "x"), (3, "zq " * 12, "en", "s", 1, "x")]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (False, True), 2: (False, False), 3: (True, False)}


def level(sizes, weights, share, most):
    """Targets by raising the water until all is dealt out."""
    total, caps, low, high = share * sum(sizes), [most * s for s in sizes], 0.0, 1e18
    for _ in range(300):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(min(c, w * middle) for c, w in zip(caps, weights)) < total else (low, middle)
    return [min(c, w * high) for c, w in zip(caps, weights)]


def test_mixing_in_full(spark, docs):  # noqa: F811
    rows = docs.select("doc_id", "text", "source").collect()
    rows = [tuple(r) for r in rows] + [(5, rows[5]["text"], "s1"), (None, "a b c", "s0"), (None, None, None)]
    table = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, source string, bucket string, key double")
    quality = spark.createDataFrame([(i, (0.1, 2.0, -1.0)[i % 3]) for i in range(0, 40, 2)], "doc_id long, w double")
    weight = {i: (0.1, 2.0, 1.0)[i % 3] for i in range(0, 40, 2)}
    unit = {r["doc_id"]: r["u"] for r in table.select("doc_id", ((F.pmod(F.xxhash64(F.lit(42), "doc_id"), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)).alias("u")).collect()}
    by = collections.defaultdict(list)
    for i, text, source in rows:
        by[source].append((-math.log(unit[i]) / weight.get(i, 1.0), i is not None, i, len(WORD.findall(text or ""))))
    sources = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(d[3] for d in by[s]) for s in sources]
    targets = level(sizes, [(5, 2, 1)[k % 3] for k in range(len(sources))], 1.5, 2.0)
    want = []
    for source, size, target in zip(sources, sizes, targets):
        epochs = int(target / size + 1e-9) if size else 0
        rest, before = target - epochs * size, 0
        for _, _, i, n in sorted(by[source], key=lambda d: (d[0], d[1], d[2] or 0, d[3])):
            want.append((str(i), str(source), n, size, round(target, 3), n * (epochs + (before + n / 2 <= rest + 1e-6))))
            before += n
    got = mix(table, quality, carry=True).collect()
    assert sorted((str(r["doc_id"]), str(r["source"]), r["size"], r["source_size"], round(r["target"], 3), r["taken"]) for r in got) == sorted(want)
    assert sorted(r["carried"]["bucket"] for r in got) == ["clash"] * len(rows)


def test_language_accuracy_ties_and_copies(spark):  # noqa: F811
    r = np.random.RandomState(1)
    words = {"en": "the of and house river stone".split(), "de": "und der haus fluss stein licht".split(), "fr": "le et maison pierre eau lumiere".split(), "el": "και σπίτι ποτάμι πέτρα νερό φως".split()}
    rows = [(i, " ".join(r.choice(words[k], 30)), k, "s", 1, "x") for i, k in enumerate(list(words) * 12)]
    rows += [(100, "the of und der", None, "s", 1, "x"), (101, "12 34 !?", None, "s", 1, "x"), (102, rows[0][1], None, "s", 1, "x"), (102, rows[0][1], None, "s", 1, "x"), (None, "σπίτι νερό", None, "s", 1, "x")]
    table = spark.createDataFrame(rows, SCHEMA)
    found = language_id.predict(table, language_id.fit(table, F.col("doc_id") % 2 == 0)).collect()
    assert len(found) == len(rows)
    truth = {x[0]: x[2] for x in rows if x[2]}
    assert all(x["lang_pred"] == truth[x["doc_id"]] for x in found if x["doc_id"] in truth and truth[x["doc_id"]] in ("en", "fr"))
    assert [x["lang_pred"] for x in found if x["doc_id"] == 101] == ["und"]
    copies = [tuple(x) for x in found if x["doc_id"] == 102]
    assert len(copies) == 2 and copies[0] == copies[1]


def test_viterbi_is_best_path():
    r = np.random.RandomState(2)
    model = language_id.Model(["a", "b", "c"], np.zeros((3, 4), np.float32), np.ones(3, np.uint16), penalty=1.5)
    score = r.randn(7, 3).astype(np.float32)
    label = model.labels(score, np.array([0, 5, 5, 7]))
    for a, b in ((0, 5), (5, 7)):
        paths = np.stack(np.meshgrid(*[range(3)] * (b - a), indexing="ij"), -1).reshape(-1, b - a)
        value = [score[np.arange(a, b), p].sum() - 1.5 * (np.diff(p) != 0).sum() for p in paths]
        assert (paths[int(np.argmax(value))] == label[a:b]).all()


def test_classifier_gradients_and_learning(spark):  # noqa: F811
    r = np.random.RandomState(4)
    good, bad = "the river and the stone ".split(), "zz 99 $$ qq ## ".split()
    rows = [(i, " ".join(r.choice(good if i % 2 else bad, 40 + 300 * (i % 5 == 0))), "en", "s", 1, "x") for i in range(120)]
    table = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, "clash") for i in range(120)] + [(None, 1, "x"), (3, None, "x")], "doc_id long, quality int, text string")
    net = quality_classifier.fit(table, labels.drop("text"), F.col("doc_id") % 4 != 2)
    found = {x["doc_id"]: x for x in quality_classifier.classify(table, net).collect()}
    assert np.mean([(found[i]["score"] >= 0.5) == (i % 2) for i in range(120) if i % 4 == 2]) == 1


def test_empty_tables(spark, empty):  # noqa: F811
    pages = spark.createDataFrame([], "page_id long, html string, url string")
    bench = spark.createDataFrame([(1, "how many red apples does the old farmer keep")], "item_id long, text string")
    assert extract_text(pages).collect() == [] and decontaminate(empty, bench).collect() == [] and decontaminate(empty, bench.limit(0)).collect() == []
    assert quality_classifier.classify(empty, quality_classifier.Network.fresh()).collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert isinstance(quality_classifier.fit(empty, labels, F.lit(True)), quality_classifier.Network)


def test_decontaminate_copies_and_long_texts(spark):  # noqa: F811
    item = "how many red apples does the old farmer keep in his large barn this winter"
    rows = [(1, "word " * 20_000 + item), (1, "word " * 20_000 + item), (2, None), (None, item), (3, item.upper() + "!")]
    table = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, values string, at int")
    bench = spark.createDataFrame([(1, item, "c"), (1, item, "c"), (None, item, "c")], "item_id long, text string, hash string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate(table, bench).collect()) == [(1, 1), (3, 1)]


@pytest.mark.parametrize("html, want", [("", ""), ("<p>a</p><!-- x --><p>b", "a\n\nb"), ("<div hidden>no</div>yes", "yes"), ("<ol><li>a<li>b</ol>", "1. a\n2. b")])
def test_html_examples(html, want):
    assert visible_text(html) == want


def test_html_broken_and_long():
    assert isinstance(visible_text("<a href='x>y" + "<b>" * 500), str)
    assert visible_text("<p>word</p>" * 20_000).count("word") == 20_000


@pytest.mark.parametrize("k", [1, 3, 127, 128, 300])
def test_labels_with_many_languages(k):
    """The path that the labels take scores as much as the best one, found state by state."""
    random = np.random.RandomState(k)
    lengths = [0, 1, 7, 12]
    ptr = np.r_[0, np.cumsum(lengths)]
    score = (random.rand(ptr[-1], k) * 40).astype(np.float32)
    model = language_id.Model([str(i) for i in range(k)], np.zeros((k, 1), np.float32), np.zeros(k, np.int64), penalty=15.0)
    found = model.labels(score, ptr).astype(int)
    assert found.size == ptr[-1] and (not found.size or 0 <= found.min() <= found.max() < k)
    for a, b in zip(ptr[:-1], ptr[1:]):
        if a == b:
            continue
        best = score[a].astype(float)
        for row in score[a + 1 : b].astype(float):
            best = np.maximum(best, best.max() - 15.0) + row
        path = found[a:b]
        worth = sum(float(score[a + i, p]) for i, p in enumerate(path)) - 15.0 * int((path[1:] != path[:-1]).sum())
        assert math.isclose(worth, best.max(), rel_tol=1e-4)
