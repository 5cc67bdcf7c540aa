"""The stages of the corpus pipeline against brute force, over rows without ids, repeated rows and clashing columns."""

import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tests.llm.test_operators import SCHEMA, WORD, spark  # noqa: F401

CLASH = SCHEMA + ", _key string, kept_text string, row string, size string, taken long, carried string, text_b string"


def texts():
    """Copies of one text with 0, 1, 2 and 3 edited words: similarities 1, 0.90, 0.81 and 0.73 to it; and other texts."""
    r = random.Random(8)
    own = [[f"w{r.random()}" for _ in range(100)] for _ in range(8)]
    found = []
    for words in own[:5]:
        for edits in range(4):
            found.append(" ".join(w if k not in (20, 50, 80)[:edits] else f"e{len(found)}" for k, w in enumerate(words)))
    return found + [" ".join(w) for w in own[5:]] + [None, ""]


def frame(spark, rows):  # noqa: F811
    """rows: doc_id, text."""
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or ""), "x", "k", "t", "r", "z", 7, "c", "b") for k, (i, t) in enumerate(rows)], CLASH)


def linked(rows, least=0.8):
    """Of each row the smallest key that it is linked to; keys: (no id, id or text)."""
    keys = {((i is None), i if i is not None else t or ""): t for i, t in rows}
    sets = {}
    for k, t in keys.items():
        w = (t or "").lower().split()
        sets[k] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    low = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    return low


def test_near_duplicate_stage(spark):  # noqa: F811
    rows = list(enumerate(texts()))
    rows += [rows[0], rows[0], (None, rows[8][1]), (None, "only here and nowhere else at all " * 3), (None, "only here and nowhere else at all " * 3)]
    low = linked(rows)
    want = sorted({(k[0], k[1] if not k[0] else None, t or "") for i, t in rows for k in [((i is None), i if i is not None else t or "")] if low[k] == k}, key=str)
    docs = frame(spark, rows)
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"] is None, r["doc_id"], r["text"] or "") for r in got.collect()), key=str) == want


def test_quality_stage(spark):  # noqa: F811
    from krylith.llm.quality_rules import quality_rules

    words = "the of and to in is that for it was on are as with his they at be this from".split()
    rows = [(i, t) for i, t in enumerate([" ".join(words), "too short", None, "bad " * 12, ""])]
    kept = {r["doc_id"] for r in quality_rules(frame(spark, rows)).where("kept").collect()}
    docs = frame(spark, rows + [(None, t) for _, t in rows] * 2)
    got = corpus_pipeline.quality_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["text"]) for r in got.collect()) == sorted((n, rows[i][1]) for i in kept for n in (False, True, True))


def test_substring_stage(spark):  # noqa: F811
    r = random.Random(4)
    some = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passage = some(50)
    rows = [(1, f"{some(20)}\n{passage} {some(9)}"), (2, passage), (None, f"{passage} tail"), (3, f"a  b\n{some(40)}"), (4, None), (5, ""), (6, "x"), (6, "x")]
    words = [WORD.findall(t or "") for _, t in rows]
    seen = {}
    for k, w in enumerate(words):
        for j in range(len(w) - 34):
            seen.setdefault(tuple(w[j : j + 35]), []).append((k, j))
    want = []
    for k, ((i, t), w) in enumerate(zip(rows, words)):
        gone = {p for places in seen.values() if len(places) > 1 for q, j in places if q == k for p in range(j, j + 35)}
        left = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else t
        if not gone or left:
            want.append((i, left, len(left or "")))
    docs = frame(spark, rows)
    got = corpus_pipeline.substring_stage(spark, docs, "")
    assert got.columns == docs.columns and got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()), key=str) == sorted(want, key=str)
    assert corpus_pipeline.substring_stage(spark, docs.drop("n_chars"), "").columns == [c for c in docs.columns if c != "n_chars"]


@pytest.fixture
def tables(spark, tmp_path):  # noqa: F811
    item = "how many red apples does the old farmer keep in his large barn this winter"
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 1, 0), (1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), item


def test_decontamination_stage(spark, tables):  # noqa: F811
    where, item = tables
    rows = [(1, f"well {item} now"), (None, item), (2, "nothing of it here"), (None, "clean too"), (3, None), (None, None), (4, "clean"), (4, "clean")]
    docs = frame(spark, rows)
    got = corpus_pipeline.decontamination_stage(spark, docs, where)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted((x for x in rows if item not in (x[1] or "")), key=str)


def test_mixing_stage(spark, tables):  # noqa: F811
    rows = [(i, "word " * (5 + i % 7)) for i in range(300)] + [(None, "a b c"), (301, None), (302, "")]
    docs = frame(spark, rows)
    got = corpus_pipeline.mixing_stage(spark, docs, tables[0])
    assert got.columns == [*docs.columns, "size_", "source_size", "target", "epochs", "taken_"]
    found = got.collect()
    by = {}
    for r in found:
        assert r["taken_"] in (r["size_"] * r["epochs"], r["size_"] * (r["epochs"] + 1)) and r["size_"] == len((r["text"] or "").split()) > 0
        by.setdefault(r["source"], []).append(r)
    for rs in by.values():
        assert abs(sum(r["taken_"] for r in rs) - rs[0]["target"]) <= 12


def test_run(spark, tables):  # noqa: F811
    where, item = tables
    r = random.Random(6)
    common = "the of and to in is that for it was on are as with his they at be this from house tree water light stone river".split()
    prose = lambda n: " ".join(r.choice(common) for _ in range(n))
    rows = [(i, prose(60)) for i in range(40)] + [(100, f"{prose(30)} {item} {prose(30)}"), (101, "short"), (102, None), (None, prose(60))]
    rows.append((50, rows[0][1]))
    frame(spark, rows).write.parquet(f"{where}/documents.parquet")
    found = corpus_pipeline.run(spark, where).collect()
    docs = frame(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, where).collect(), CLASH)
    assert {(r["doc_id"], r["text"]) for r in found} <= {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert not {50, 100, 101, 102} & {r["doc_id"] for r in found} and all(re.search("[a-z]", r["text"]) for r in found)


def test_empty(spark, tables):  # noqa: F811
    docs = frame(spark, [(1, "x")]).where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables[0]).collect() == []
    assert docs.select(F.lit(1)).count() == 0
