"""Substring dedup over rows without ids, rows that share one, repeated rows; the index over many batches."""

import collections
import hashlib
import random

import pytest

from krylith.llm.substring_dedup import FingerprintIndex, substring_dedup
from krylith.llm.tables import Scratch
from tests.llm.test_operators import WORD, spark  # noqa: F401


def brute(texts, width=35):
    words = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
    for w in words:
        gone = {p for k in range(len(w) - width + 1) if seen[tuple(w[k : k + width])] > 1 for p in range(k, k + width)}
        yield len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()


@pytest.mark.parametrize("batches", [1, 9])
def test_rows(spark, batches):  # noqa: F811
    r = random.Random(5)
    text = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    shared, b = text(34), text(40)
    passage = text(60)
    rows = [(1, shared), (1, b), (2, b), (None, text(50) + " " + passage), (None, passage), (None, passage), (3, shared + " x"), (4, passage[:-1]), (5, None), (6, ""), (6, ""), (7, " ".join(["same"] * 500)), (8, text(3000) + "\n" + passage + " " + text(3000))]
    docs = spark.createDataFrame([(i, t, k, "clash") for k, (i, t) in enumerate(rows)], "doc_id long, text string, row long, hashes string")
    got = {r["row"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup(docs, batches=batches, row_col="row").collect()}
    assert got == dict(enumerate(brute([t for _, t in rows])))
    ids = collections.Counter(r["doc_id"] for r in substring_dedup(docs, batches=batches).collect())
    assert ids == collections.Counter(i for i, _ in rows)


def test_index_compacts_and_reopens(spark, tmp_path):  # noqa: F811
    r = random.Random(2)
    batches = [[r.randrange(400) for _ in range(60)] for _ in range(23)]
    seen, given = collections.Counter(), set()
    index = FingerprintIndex(Scratch(spark), 4, str(tmp_path / "index"))
    for k, batch in enumerate(batches):
        if k in (7, 16):  # another session goes on with the stored runs
            index = FingerprintIndex(Scratch(spark), 4, str(tmp_path / "index"))
        found = {x["hash"] for x in index.ingest(spark.createDataFrame([(x,) for x in batch], "hash long")).collect()}
        now = collections.Counter(batch)
        assert {x for x in now if now[x] + seen[x] > 1 and seen[x] < 2} <= found <= {x for x in now if now[x] + seen[x] > 1}
        seen, given = seen + now, given | found
        assert given == {x for x in seen if seen[x] > 1}
        assert [len(level) for level in index.levels] == [(k + 1) // 4**n % 4 for n in range(len(index.levels))]
    total = collections.Counter()
    for run in index.runs():
        for x in run.collect():
            total[x["hash"]] += x["n"]
    assert total == seen


def test_runs_are_merge_joined(spark):  # noqa: F811
    scratch = Scratch(spark)
    index = FingerprintIndex(scratch, 4)
    one, two = (index.write(spark.range(50).selectExpr("id * 7 % 50 as hash", "1L as n"), 0) for _ in range(2))
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = one.join(two.where("n = 1").select("hash"), "hash", "left_semi")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.legacy.bucketedTableScan.outputOrdering")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
