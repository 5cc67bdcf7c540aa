"""Benchmark items that templates alone can't tell: short ones and those made mostly of placeholders."""

from krylith.llm import decontaminate as D
from tests.llm.test_operators import spark  # noqa: F401


def found(spark, texts, items):  # noqa: F811
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_item_windows"]) for r in D.decontaminate(docs, bench).collect()}


def test_exact_windows(spark, monkeypatch):  # noqa: F811
    short, numbers, plain = "Who wrote Hamlet?", "What is 12 + 35 + 7 - 4?", "how many red apples does the old farmer keep in his barn"
    texts = [f"They asked {short} Nobody knew.", "who wrote hamlet", "Who wrote Othello?", f"so {numbers} of them", "What is 12 + 35 + 7 - 5?", f"well {plain} now", None, "", "who wrote"]
    want = {(0, 0): (1, 1), (1, 0): (1, 1), (3, 1): (1, 1), (5, 2): (7, 7)}
    assert found(spark, texts, [short, numbers, plain, None, "", " ?! "]) == want
    monkeypatch.setattr(D, "BROADCAST_ROWS", -1)
    assert found(spark, texts, [short, numbers, plain, None, "", " ?! "]) == want


def test_exact_windows_take_nothing_from_templates(spark):  # noqa: F811
    item = "please add the numbers that follow here 1 2 3 4 5 6 7 8 9 10 11 12"
    other = item.split(" here")[0] + " here 91 92 93"
    part = "some text 3 4 5 6 7 8 9 10 11 12"
    assert set(found(spark, [item, other, part, part.replace("8", "80")], [item])) == {(0, 0), (1, 0), (2, 0)}
