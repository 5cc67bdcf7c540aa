"""The text queries that SQL can express agree with DuckDB, on the smallest tables and on made ones."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from krylith.llm import queries
from tests.llm.test_operators import spark  # noqa: F401

ITEMS = [
    "Tom Baker bought 12 apples for 3 dollars each. How much did Tom Baker pay in total?",
    "Compute 12 + 35 + 7 - 4 = 50 kg",
    "Why, then?",
    "A train leaves Paris at 9:30 and travels 120km in 2 hours, then 80km in 1 hour; what is its speed?",
    "",
    None,
    "In  Rome   An Bo Ci met Di Eo at the old bridge near the river bank on Monday.",
]


def tables(folder) -> str:
    pick = random.Random(5)
    vocabulary = ["river", "Stone", "42", "Anna", "kg", "over", "7km", "mile.", "(and)", "--", "the", "Über", "x"]
    prose = lambda n: pick.choice([" ", "  ", "\n"]).join(pick.choices(vocabulary, k=n))
    passage = prose(60)
    texts = [None, "", " \n", "one two", "one two", "ONE two"]
    texts += [i for i in ITEMS if i] + [i.replace("Tom", "Sue").replace("12", "19").replace("Paris", "Lyon") for i in ITEMS if i]
    texts += [f"{prose(pick.randrange(30))} {i} {prose(pick.randrange(30))}" for i in ITEMS if i]
    texts += ["Tom Baker bought 12 apples for 3 dollars each. How much did Ann Baker pay in total?"]  # one slot differs from itself
    texts += [prose(pick.randrange(1, 200)) for _ in range(40)]
    texts += [f"{prose(20)} {passage} {prose(pick.randrange(40))}" for _ in range(5)]
    base = prose(120).split(" ")
    for k in range(12):
        words = list(base)
        for _ in range(k // 3):
            words[pick.randrange(len(words))] = "new"
        texts.append(" ".join(words))
    texts += [texts[30]] * 3
    n = len(texts)
    sources = [pick.choice(["web", "web", "web", "Book", "wiki", "é", None]) for _ in range(n)]
    made = {
        "documents": pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array([None] * n, pa.string()), "source": pa.array(sources, pa.string()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}),
        "benchmark": pa.table({"item_id": pa.array(range(len(ITEMS)), pa.int64()), "text": pa.array(ITEMS, pa.string())}),
        "labels": pa.table({"doc_id": pa.array([1, 2, 20, 21, 22, 22, None, 40], pa.int64()), "quality": pa.array([1, 0, 1, 0, 0, 1, 1, None], pa.int64()), "toxic": pa.array([0] * 8, pa.int64())}),
    }
    for name, table in made.items():
        pq.write_table(table, f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("made"))


@pytest.mark.parametrize("which", ["sf0.001", "made"])
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, made, name, which):  # noqa: F811
    folder = made if which == "made" else f"/root/testdata/{which}"
    db = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = sorted(found.fetchall(), key=repr)
    frame = queries.queries()[name](spark, folder)
    assert sorted(frame.columns) == sorted(columns)
    assert sorted(map(tuple, frame.select(columns).collect()), key=repr) == want
    assert want
