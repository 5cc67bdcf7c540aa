"""What larger tables need: sparse approximate inverses, small blocks, dense rows filled in one go."""

import numpy as np
import pytest
from pyspark.sql import SparkSession

from krylith.operators import storage
from krylith.plans import solvers
from krylith.plans.runtime import LocalOperator


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def ring(n):
    """Rows, columns and values of a ring of n, dominated by its diagonal."""
    k = np.arange(n)
    return np.r_[k, k, k], np.r_[k, (k + 1) % n, (k - 1) % n], np.r_[np.full(n, 3.0) + k % 5, np.full(2 * n, -1.0)]


def frame(spark, n):
    return spark.createDataFrame([(int(i), int(j), float(v)) for i, j, v in zip(*ring(n))], "i long, j long, v double")


def test_vbr_blocks_stay_small(spark):
    a = frame(spark, 301)
    packed = storage.pack(a, 301, "vbr")
    assert max(len(r["val"]) for r in packed.collect()) <= 9
    assert sorted(map(tuple, storage.unpack(packed, "vbr").collect())) == sorted(map(tuple, a.collect()))
    x = spark.createDataFrame([(i, float(i)) for i in range(301)], "i long, v double")
    i, j, v = ring(301)
    assert np.allclose([r["v"] for r in storage.spmv(packed, "vbr", x).orderBy("i").collect()], np.bincount(i, v * j))


def test_vbr_product_needs_no_lookup(spark):
    """A cell of a block isn't looked up among the block's entries."""
    plan = storage.spmv(storage.pack(frame(spark, 30), 30, "vbr", bounds=[0, 10, 11]), "vbr", spark.range(30).selectExpr("id AS i", "1.0D AS v"))
    assert "map_from_entries" not in plan._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in plan.collect()) == [(i, 1.0 + i % 5) for i in range(30)]


def test_dense_rows_are_filled_in_one_go(spark):
    a = frame(spark, 50).where("i <> 7")
    packed = storage.pack(a, 50, "dns")
    assert "map_from_entries" not in packed._jdf.queryExecution().toString()
    assert {len(r["val"]) for r in packed.collect()} == {50}
    assert sorted(map(tuple, storage.unpack(packed, "dns").collect())) == sorted(map(tuple, a.collect()))
    with pytest.raises(Exception, match="two entries"):
        storage.pack(a.union(a), 50, "dns").collect()


@pytest.mark.parametrize("method", ["bicg", "cg", "gmres"])
def test_sainv_of_many_rows(method):
    """More rows than a dense inverse was allowed."""
    a, u = LocalOperator(*ring(4200), 4200), 1.0 + np.arange(4200) % 7
    found = solvers.solve(a, a.dot(u), method, "sainv", tol=1e-11)
    assert found.status == solvers.SUCCESS and np.allclose(found.x, u, atol=1e-6)
