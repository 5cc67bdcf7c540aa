"""File round trips, splits, symmetries and malformed files."""

import pytest
from pyspark.sql import SparkSession

from krylith.sources import harwell_boeing, matrix_market
from krylith.sources.generators import laplace, toeplitz


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def file(tmp_path, text):
    path = tmp_path / "f"
    path.write_text(text)
    return str(path)


def test_matrix_market_round_trip(spark, tmp_path):
    a, b = laplace(spark, 4, 3), spark.createDataFrame([(i, float(i)) for i in range(12)], "i long, v double")
    matrix_market.write(a, 12, str(tmp_path / "m"), b)
    back, n, rhs, x = matrix_market.read(spark, str(tmp_path / "m"))
    assert n == 12 and x is None
    assert rows(back) == rows(a) and rows(rhs) == rows(b)
    assert toeplitz(spark, 20, 2.0).count() == 57


def test_entry_like_the_size_line(spark, tmp_path):
    back, n, _, _ = matrix_market.read(spark, file(tmp_path, "%%MatrixMarket matrix coordinate real general\n% a note\n2 2 4\n1 1 7\n1 2 1\n\n2 1 1\n2 2 4\n"))
    assert (n, rows(back)) == (2, [(0, 0, 7.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 4.0)])


@pytest.mark.parametrize("head, body, want", [
    ("coordinate real symmetric", "2 2 2\n1 1 3\n2 1 5", [(0, 0, 3.0), (0, 1, 5.0), (1, 0, 5.0)]),
    ("coordinate real skew-symmetric", "2 2 1\n2 1 5", [(0, 1, -5.0), (1, 0, 5.0)]),
    ("coordinate pattern general", "2 2 1\n2 1", [(1, 0, 1.0)]),
    ("coordinate complex hermitian", "2 2 2\n1 1 3 0\n2 1 5 2", [(0, 0, 3.0, 0.0), (0, 1, 5.0, -2.0), (1, 0, 5.0, 2.0)]),
    ("coordinate complex symmetric", "2 2 1\n2 1 5 2", [(0, 1, 5.0, 2.0), (1, 0, 5.0, 2.0)]),
    ("array real general", "2 2\n1\n2\n3\n4", [(0, 0, 1.0), (0, 1, 3.0), (1, 0, 2.0), (1, 1, 4.0)]),
])
def test_kinds(spark, tmp_path, head, body, want):
    assert rows(matrix_market.read(spark, file(tmp_path, f"%%MatrixMarket matrix {head}\n{body}\n"))[0]) == want


@pytest.mark.parametrize("text", ["hello\n1 1 1\n1 1 1\n", "%%MatrixMarket matrix coordinate real general\n2 3 0\n", "%%MatrixMarket matrix coordinate real general\n2 2 3\n1 1 1\n", "%%MatrixMarket matrix coordinate real general\n"])
def test_malformed(spark, tmp_path, text):
    with pytest.raises(ValueError):
        matrix_market.read(spark, file(tmp_path, text))


def test_many_splits(spark, tmp_path):
    a, x = laplace(spark, 30, 30), spark.createDataFrame([(i, i / 7) for i in range(900)], "i long, v double")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        path = tmp_path / "one"
        path.write_text("\n".join(r["value"] for r in matrix_market.text(a, 900, x, x).orderBy("part", "i", "j").collect()) + "\n")
        back, _, b, again = matrix_market.read(spark, str(path))
        assert rows(back) == rows(a) and rows(b) == rows(again) == rows(x)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_array_file_by_columns(spark, tmp_path):
    """A column is written at once, its zeros short, and lines are numbered without a sort, whatever the splits."""
    a, path = toeplitz(spark, 40, 2.0).where("j <> 7"), tmp_path / "m"
    lines = matrix_market.array_text(a, 40)
    assert lines.count() == 42
    matrix_market.put(lines, str(path))
    matrix_market.write_array(a, 40, str(tmp_path / "again"))
    text = ["".join(p.read_text() for p in sorted(f.glob("part-*"))).split("\n") for f in (path, tmp_path / "again")]
    assert text[0] == text[1] and len(text[0]) == 1603 and text[0].count("0") == 1600 - a.count()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        back = matrix_market.read(spark, str(path))[0]
        assert "row_number" not in back._jdf.queryExecution().toString()
        assert back.count() == 1600 and rows(back.where("v <> 0")) == rows(a)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(Exception, match="two entries"):
        matrix_market.array_text(a.union(a), 40).collect()


def test_vectors(spark, tmp_path):
    assert rows(matrix_market.read_vector(spark, file(tmp_path, "1.5 2 3\n4 5\n"))[0]) == [(0, 1.5), (1, 2.0), (2, 3.0), (3, 4.0), (4, 5.0)]
    assert rows(matrix_market.read_vector(spark, file(tmp_path, "%%MatrixMarket vector coordinate complex general\n2\n2 1 4\n1 5 6\n"))[0]) == [(0, 5.0, 6.0), (1, 1.0, 4.0)]
    matrix_market.write_history(spark, [1.0, 0.25, 0.5], str(tmp_path / "h"))
    assert rows(matrix_market.read_vector(spark, str(tmp_path / "h"))[0]) == [(0, 1.0), (1, 0.25), (2, 0.5)]


def test_harwell_boeing(spark, tmp_path):
    text = harwell_boeing.text([(0, 0, 1.0), (2, 0, -2.5), (1, 1, 3.0), (0, 2, 1e-30)], 3, [1.0, 2.0, 3.0])
    a, n, b, x = harwell_boeing.read(spark, file(tmp_path, text))
    assert n == 3 and x is None and rows(a) == [(0, 0, 1.0), (0, 2, 1e-30), (1, 1, 3.0), (2, 0, -2.5)] and rows(b) == [(0, 1.0), (1, 2.0), (2, 3.0)]
    assert harwell_boeing.widths("(1P5D16.8)") == (5, 16) and harwell_boeing.real("1.5D-3") == harwell_boeing.real("1.5-3") == 0.0015
    with pytest.raises(ValueError):
        harwell_boeing.parse(text.replace("RUA", "RSA"))
