"""The text operators against brute force on small tables with nulls, empty, repeated and very long texts."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from krylith.llm import attention_lm, language_id, quality_classifier
from krylith.llm.decontaminate import decontaminate
from krylith.llm.html_text import extract_text, visible_text
from krylith.llm.mixing import mix
from krylith.llm.near_duplicates import near_duplicates
from krylith.llm.quality_rules import quality_rules
from krylith.llm.substring_dedup import substring_dedup
from krylith.llm.token_counts import token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bands string"


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    yield session
    session.stop()


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choice(["ba", "ti", "ro", "Né", "su"]) for _ in range(r.randint(1, 3)))
    base = [word() for _ in range(120)]
    texts = [" ".join(base), "\n".join([" ".join(base[:60]), " ".join(base[60:])]), None, "", " \n ", "one", "One", "a b c d", "bad bad bad bad bad bad bad bad bad bad bad bad"]
    for k in range(30):
        own = list(base) if k % 3 else [word() for _ in range(90)]
        for _ in range(k % 5):
            own[r.randrange(len(own))] = word()
        texts.append(" ".join(own))
    texts.append(" ".join(word() for _ in range(20_000)))
    return [(i, t, None if i % 7 == 0 else ("en", "fr")[i % 2], None if i % 11 == 0 else f"s{i % 4}", 1, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates(docs):
    sets, parent = {}, {}
    for i, text, *_ in corpus():
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
        parent[i] = i

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()}
    assert got == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def test_substring_dedup(docs):
    words = {i: WORD.findall(t or "") for i, t, *_ in corpus()}
    seen = collections.Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    for r in substring_dedup(docs).collect():
        w = words[r["doc_id"]]
        gone = {p for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_quality_rules(docs):
    got = {r["doc_id"]: r for r in quality_rules(docs).collect()}
    for i, text, *_ in corpus():
        w = WORD.findall(text or "")
        count = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {p for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Hello WORLD's 42nd", "<|endoftext|> x<|endoftext|>y", "naïve Ångström Σας İx", "日本語 text", "a b\x1cc", "é é", "", None, "!!! don't"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(frame).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_language_id(docs, empty):
    fold = F.col("doc_id") % 2 == 0
    got = {r["doc_id"]: r for r in language_id.predict(docs, language_id.fit(docs, fold)).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    untrained = language_id.predict(docs, language_id.fit(empty, fold))
    assert {r["lang_pred"] for r in untrained.collect()} == {"und"}


def test_attention_lm(docs):
    got = {r["doc_id"]: r for r in attention_lm.score(docs, F.col("doc_id") % 3 > 0).collect()}
    tokens = {i: [*(re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")), "</end> "] for i, t, *_ in corpus()}
    count = collections.Counter(w for i, ws in tokens.items() if i % 3 for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r["score"] <= 0


@pytest.mark.parametrize("scale", [1, 300])
def test_attention_scores_as_it_trains(scale):
    rand, of = np.random.RandomState(3), np.arange(400) % attention_lm.CLASSES
    counts, after = rand.randint(1, 50, of.size), rand.randint(0, 9, (of.size, attention_lm.CLASSES))
    model = attention_lm.Attention(attention_lm.Classes(of), attention_lm.Statistics.from_counts(counts, after, after, np.minimum(counts, 2), of))
    for k in ("query", "out", "bias"):
        model.w[k] = (model.w[k] + (k == "bias") * rand.randn(*model.w[k].shape) * 0.1).astype(np.float32) * scale
    ids, goal = rand.randint(0, of.size, (9, attention_lm.SPAN)), rand.randint(-1, attention_lm.CLASSES, (9, attention_lm.BODY))
    ids[:4, :5] = -1
    loss = model.gradients(ids, goal)[0]
    hit, begins = model.prepared().places(ids, goal)
    assert np.isfinite(hit).all() and (begins <= 1e-6).all()
    assert np.minimum(-hit[goal.ravel() >= 0], -np.log(1e-30)).mean() == pytest.approx(loss, rel=1e-3)


def test_mixing(docs, empty):
    got = mix(docs).collect()
    assert len(got) == len(corpus())
    total, by_source = sum(r["size"] for r in got), collections.defaultdict(list)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_source[r["source"]].append(r)
    assert math.isclose(sum(rs[0]["target"] for rs in by_source.values()), 1.5 * total, rel_tol=1e-9)
    for rs in by_source.values():
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= max(r["size"] for r in rs)
    assert sorted(got) == sorted(mix(docs).collect())


def test_decontaminate(spark):
    item = "If Maria buys 12 apples for 3 dollars each and then Maria sells 12 pears how much is left"
    other = item.replace("12", "57").replace("Maria", "Peter")
    mixed_up = item.replace("12 apples", "57 apples").replace("12 pears", "99 pears")
    texts = [f"Some words first. {item} and more", f"lead in {other}", f"lead in {mixed_up}", "nothing of the kind here at all, only clean words", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(5, item), (6, None), (7, "short")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate(docs, bench).collect()} == {0, 1}


def test_html(spark):
    assert visible_text("<p>One<p>Two<ul><li>x<li>y</ul><table><tr><td>a<td>bb<tr><td>ccc<td>d</table><script>no</script>") == "One\n\nTwo\n\n- x\n- y\n\na    bb\nccc  d"
    assert visible_text("<div>" * 50_000 + "x") == "x" and visible_text("a < b") == "a < b"
    pages = spark.createDataFrame([(1, None), (2, "<b>x"), (2, "<b>x")], "page_id long, html string")
    assert sorted(tuple(r) for r in extract_text(pages).collect()) == [(1, ""), (2, "x"), (2, "x")]


def test_classifier(docs):
    net = quality_classifier.Network.fresh()
    scores = {r["doc_id"]: r["score"] for r in quality_classifier.classify(docs, net).collect()}
    assert scores[2] == scores[3] and all(0 <= s <= 1 for s in scores.values())


@pytest.mark.parametrize("operator", [near_duplicates, substring_dedup, quality_rules, token_counts, mix])
def test_empty_tables(empty, operator):
    assert operator(empty).collect() == []


def test_fold_is_crc(docs):
    from krylith.llm.queries import fold

    got = {r["doc_id"]: r["f"] for r in docs.select("doc_id", fold(5).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 for i in got}
