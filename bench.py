"""Times the headline queries; prints one JSON line. The in-memory solves are timed apart from building their systems."""

import json
import os
import time

import numpy as np
from pyspark.sql import SparkSession

from krylith.plans import catalog, solvers
from krylith.plans.runtime import operator
from krylith.sources.generators import laplace

HEADLINE = ("matvec", "matvech", "gram", "mat_normf", "vec_dot", "to_csr", "to_ell", "spmv_csr", "solve_bicg", "solve_cg_ssor", "solve_bicgstab", "solve_gmres_iluk", "eig_cr")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    run = catalog.queries()
    run["matvec"](spark, sf_dir).count()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        run[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    grid = operator(laplace(spark, 10, 10), 100)  # the system of the published figure
    b = grid.dot(np.ones(100))
    solves = sorted(solvers.solve(grid, b, "bicg").seconds for _ in range(20))
    took["bicg_100x460_in_memory"] = round(solves[10], 6)
    large = operator(laplace(spark, 300, 300), 90_000)
    x = np.ones(90_000)
    began = time.perf_counter()
    for _ in range(50):
        large.dot(x)
    took["spmv_90000_in_memory"] = round((time.perf_counter() - began) / 50, 6)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
