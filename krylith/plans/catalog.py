"""The registered queries of the linear-algebra engine and the SQL each is compared with.

Sources: W[part, supplier] = sum of lineitem quantities, x and y vectors over parts, z over
suppliers. Square matrices over suppliers, of all lineitem rows: A, not symmetric, with up to five
entries beside a dominant diagonal that varies, and H, its symmetric like; E, whose eigenvalues are
known from the account balances. T: quantities traded between nations, at most 25 x 25. Floating
sums are rounded so that their order has no influence.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from krylith.functions import dense, numbers
from krylith.functions import double_double as dd
from krylith.operators import matrix as M
from krylith.operators import storage
from krylith.operators import vector as B
from krylith.plans import options, preconditioners, solvers
from krylith.plans.runtime import BlockOperator, LocalOperator, operator
from krylith.sources import harwell_boeing, matrix_market
from krylith.sources.generators import laplace, toeplitz
from krylith.sources.shared import folder

WSQL = "SELECT l_partkey AS i, l_suppkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2"
XSQL = "SELECT p_partkey AS i, CAST(p_retailprice AS DOUBLE) AS v FROM part"
YSQL = "SELECT p_partkey AS i, CAST(p_size AS DOUBLE) AS v FROM part"
ZSQL = "SELECT s_suppkey AS i, CAST(s_acctbal AS DOUBLE) AS v FROM supplier"
OFFSQL = "SELECT l_suppkey AS i, (l_suppkey + 1 + l_partkey % 5) % (SELECT count(*) FROM supplier) AS j, -sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2"
DIAGSQL = "SELECT s_suppkey AS i, s_suppkey AS j, 1 + coalesce(t, 0) * (1.1 + (s_suppkey % 5) / 10.0) AS v FROM supplier LEFT JOIN (SELECT i AS s_suppkey, sum(abs(v)) AS t FROM {} GROUP BY 1) USING (s_suppkey)"
TSQL = "SELECT c_nationkey AS i, s_nationkey AS j, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"
WITH = (
    f"WITH w AS ({WSQL}), x AS ({XSQL}), y AS ({YSQL}), z AS ({ZSQL}), ao AS (SELECT i, j, sum(v) AS v FROM ({OFFSQL}) WHERE i <> j GROUP BY 1, 2), a AS (SELECT i, j, v FROM ao UNION ALL {DIAGSQL.format('ao')}), "
    f"ho AS (SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM ao UNION ALL SELECT j, i, v FROM ao) GROUP BY 1, 2), h AS (SELECT i, j, v FROM ho UNION ALL {DIAGSQL.format('ho')}), t AS ({TSQL}), u AS (SELECT n_nationkey AS i, CAST(1 + n_nationkey % 7 AS DOUBLE) AS v FROM nation) "
)


def w(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).agg(F.sum("l_quantity").alias("v"))


def column(table: str, key: str, value: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: spark.read.parquet(f"{d}/{table}.parquet").select(F.col(key).alias("i"), F.col(value).cast("double").alias("v"))


x, y, z = column("part", "p_partkey", "p_retailprice"), column("part", "p_partkey", "p_size"), column("supplier", "s_suppkey", "s_acctbal")


def beside(spark: SparkSession, d: str) -> DataFrame:
    """The entries of A beside its diagonal."""
    n = F.broadcast(spark.read.parquet(f"{d}/supplier.parquet").agg(F.count("*").alias("n")))
    rows = spark.read.parquet(f"{d}/lineitem.parquet").join(n).select(F.col("l_suppkey").alias("i"), ((F.col("l_suppkey") + 1 + F.col("l_partkey") % 5) % F.col("n")).alias("j"), (-F.col("l_quantity")).alias("v"))
    return rows.where("i <> j").groupBy("i", "j").agg(F.sum("v").alias("v"))


def dominated(spark: SparkSession, d: str, off: DataFrame) -> DataFrame:
    """off with a diagonal that exceeds each row's sum by 10 to 50 %, and by 1."""
    sums = off.groupBy("i").agg(F.sum(F.abs("v")).alias("t"))
    ids = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("i"))
    diagonal = ids.join(sums, "i", "left").select("i", F.col("i").alias("j"), (1 + F.coalesce("t", F.lit(0.0)) * (1.1 + F.col("i") % 5 / 10)).alias("v"))
    return off.unionByName(diagonal)


def a(spark: SparkSession, d: str) -> DataFrame:
    return dominated(spark, d, beside(spark, d))


def h(spark: SparkSession, d: str) -> DataFrame:
    off = beside(spark, d)
    return dominated(spark, d, M.axpy(1.0, off, M.transpose(off)))


def turns(spark: SparkSession, d: str, first: int) -> DataFrame:
    """Rotations of the index pairs (first, first + 1), (first + 2, first + 3) and so on, by angles that vary; the identity elsewhere."""
    ids = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("i"))
    n = F.broadcast(ids.agg(F.count("*").alias("n")))
    low = F.when((F.col("i") - first) % 2 == 0, F.col("i")).otherwise(F.col("i") - 1)
    angle, paired = 0.3 + F.col("low") % 4 / 10, (F.col("low") >= 0) & (F.col("low") + 1 < F.col("n")) & (F.col("i") >= first)
    rows = ids.join(n).withColumn("low", low)
    e = F.when(paired, F.array(F.struct(F.col("i").alias("j"), F.cos(angle).alias("v")), F.struct((2 * F.col("low") + 1 - F.col("i")).alias("j"), F.when(F.col("i") == F.col("low"), -F.sin(angle)).otherwise(F.sin(angle)).alias("v"))))
    return rows.select("i", F.explode(F.coalesce(e, F.array(F.struct(F.col("i").alias("j"), F.lit(1.0).alias("v"))))).alias("e")).select("i", "e.j", "e.v")


def spectral(spark: SparkSession, d: str) -> DataFrame:
    """E: two layers of rotations around the diagonal of the balances from 1001 upwards, so these are its eigenvalues."""
    found = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("i"), F.col("s_suppkey").alias("j"), (F.col("s_acctbal") + 1001).cast("double").alias("v"))
    for first in (0, 1):
        g = turns(spark, d, first)
        found = M.matmat(M.matmat(g, found), M.transpose(g))
    return found


def trade(spark: SparkSession, d: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    joined = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy(F.col("c_nationkey").alias("i"), F.col("s_nationkey").alias("j")).agg(F.sum("l_quantity").cast("double").alias("v"))


def known(n: int) -> np.ndarray:
    return 1.0 + np.arange(n) % 7


def rounded(frame: DataFrame, digits: int = 4) -> DataFrame:
    return frame.withColumns({c: F.round(c, digits) + F.lit(0.0) for c, kind in frame.dtypes if kind == "double"})


#: name: (query, the select over the WITH tables)
TABLE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "vec_axpy": (lambda s, d: B.axpy(2.0, x(s, d), y(s, d)), "SELECT i, 2 * x.v + y.v AS v FROM x JOIN y USING (i)"),
    "vec_xpay": (lambda s, d: B.xpay(x(s, d), 3.0, y(s, d)), "SELECT i, x.v + 3 * y.v AS v FROM x JOIN y USING (i)"),
    "vec_axpyz": (lambda s, d: B.axpy(-0.5, x(s, d), y(s, d)), "SELECT i, -0.5 * x.v + y.v AS v FROM x JOIN y USING (i)"),
    "vec_scale": (lambda s, d: B.scale(1.5, x(s, d)), "SELECT i, 1.5 * v AS v FROM x"),
    "vec_pmul": (lambda s, d: B.pmul(x(s, d), y(s, d)), "SELECT i, x.v * y.v AS v FROM x JOIN y USING (i)"),
    "vec_pdiv": (lambda s, d: B.pdiv(x(s, d), y(s, d)), "SELECT i, x.v / y.v AS v FROM x JOIN y USING (i)"),
    "vec_set_all": (lambda s, d: B.set_all(7.0, x(s, d)), "SELECT i, 7.0::DOUBLE AS v FROM x"),
    "vec_abs": (lambda s, d: B.absolute(z(s, d)), "SELECT i, abs(v) AS v FROM z"),
    "vec_reciprocal": (lambda s, d: B.reciprocal(y(s, d)), "SELECT i, 1 / v AS v FROM y"),
    "vec_shift": (lambda s, d: B.shift(10.0, x(s, d)), "SELECT i, v - 10 AS v FROM x"),
    "vec_dot": (lambda s, d: B.dot(x(s, d), y(s, d)), "SELECT sum(x.v * y.v) AS value FROM x JOIN y USING (i)"),
    "vec_nrm1": (lambda s, d: B.nrm1(z(s, d)), "SELECT sum(abs(v)) AS value FROM z"),
    "vec_nrm2": (lambda s, d: B.nrm2(z(s, d)), "SELECT sqrt(sum(v * v)) AS value FROM z"),
    "vec_nrmi": (lambda s, d: B.nrmi(z(s, d)), "SELECT max(abs(v)) AS value FROM z"),
    "vec_sum": (lambda s, d: B.total(z(s, d)), "SELECT sum(v) AS value FROM z"),
    "vec_set_values_ins": (lambda s, d: B.set_values(x(s, d), updates(s, d), False), "SELECT x.i, coalesce(u.v, x.v) AS v FROM x LEFT JOIN (SELECT l_partkey AS i, arg_max(l_quantity, (l_orderkey * 10 + l_linenumber) * 1000 + l_quantity) AS v FROM lineitem GROUP BY 1) u USING (i)"),
    "vec_set_values_add": (lambda s, d: B.set_values(x(s, d), updates(s, d), True), "SELECT x.i, x.v + coalesce(u.v, 0) AS v FROM x LEFT JOIN (SELECT l_partkey AS i, sum(l_quantity) AS v FROM lineitem GROUP BY 1) u USING (i)"),
    "mat_set_value_add": (lambda s, d: M.assemble(entries(s, d)), "SELECT i, j, v FROM w"),
    "mat_set_value_ins": (lambda s, d: M.assemble(entries(s, d), False), "SELECT l_partkey AS i, l_suppkey AS j, arg_max(l_quantity, (l_orderkey * 10 + l_linenumber) * 1000 + l_quantity) AS v FROM lineitem GROUP BY 1, 2"),
    "matvec": (lambda s, d: M.matvec(w(s, d), z(s, d)), "SELECT w.i, sum(w.v * z.v) AS v FROM w JOIN z ON w.j = z.i GROUP BY 1"),
    "matvech": (lambda s, d: M.matvech(w(s, d), x(s, d)), "SELECT w.j AS i, sum(w.v * x.v) AS v FROM w JOIN x ON w.i = x.i GROUP BY 1"),
    "mat_transpose": (lambda s, d: M.transpose(w(s, d)), "SELECT j AS i, i AS j, v FROM w"),
    "mat_normf": (lambda s, d: M.normf(w(s, d)), "SELECT sqrt(sum(v * v)) AS value FROM w"),
    "mat_diag": (lambda s, d: M.diagonal(w(s, d)), "SELECT i, v FROM w WHERE i = j"),
    "mat_split_l": (lambda s, d: M.split(w(s, d), "l"), "SELECT i, j, v FROM w WHERE i > j"),
    "mat_split_d": (lambda s, d: M.split(w(s, d), "d"), "SELECT i, j, v FROM w WHERE i = j"),
    "mat_split_u": (lambda s, d: M.split(w(s, d), "u"), "SELECT i, j, v FROM w WHERE i < j"),
    "mat_merge": (lambda s, d: M.merge(*(M.split(w(s, d), p) for p in "ldu")), "SELECT i, j, v FROM w"),
    "gram": (lambda s, d: M.gram(w(s, d)), "SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM w a JOIN w b USING (i) GROUP BY 1, 2"),
    "to_ell": (lambda s, d: M.to_ell(w(s, d)), "SELECT i, row_number() OVER (PARTITION BY i ORDER BY j) - 1 AS slot, j, v FROM w"),
    "matmat": (lambda s, d: M.matmat(a(s, d), h(s, d)), "SELECT a.i AS i, h.j AS j, sum(a.v * h.v) AS v FROM a JOIN h ON a.j = h.i GROUP BY 1, 2"),
    "psd_set_value": (lambda s, d: M.set_existing(a(s, d), a(s, d).where("i = j").select(F.col("i").alias("seq"), "i", (F.col("j") * F.lit(1)).alias("j"), (F.col("i") + 9.0).alias("v"))), "SELECT i, j, CASE WHEN i = j THEN i + 9.0 ELSE v END::DOUBLE AS v FROM a"),
    "mat_axpy": (lambda s, d: M.axpy(2.0, a(s, d), M.transpose(h(s, d))), "SELECT i, j, sum(v) AS v FROM (SELECT i, j, 2.0 * v AS v FROM a UNION ALL SELECT j, i, v FROM h) GROUP BY 1, 2"),
    "mat_xpay": (lambda s, d: M.xpay(a(s, d), 4.0, h(s, d)), "SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM a UNION ALL SELECT i, j, 4.0 * v FROM h) GROUP BY 1, 2"),
    "mat_axpyz": (lambda s, d: M.axpyz(-3.0, M.transpose(a(s, d)), h(s, d)), "SELECT i, j, sum(v) AS v FROM (SELECT j AS i, i AS j, -3.0 * v AS v FROM a UNION ALL SELECT i, j, v FROM h) GROUP BY 1, 2"),
    "mat_shift": (lambda s, d: M.shift_diagonal(a(s, d), 0.5), "SELECT i, j, CASE WHEN i = j THEN v - 0.5 ELSE v END::DOUBLE AS v FROM a"),
    "mat_shift_matrix": (lambda s, d: M.shift_matrix(a(s, d), h(s, d), 0.25), "SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM a UNION ALL SELECT i, j, -0.25 * v FROM h) GROUP BY 1, 2"),
    "mat_scale_jacobi": (lambda s, d: M.scale(a(s, d)), "SELECT a.i AS i, a.j AS j, a.v / d.v AS v FROM a JOIN a d ON d.i = a.i AND d.i = d.j"),
    "mat_scale_symm": (lambda s, d: M.scale(a(s, d), True), "SELECT a.i AS i, a.j AS j, a.v / sqrt(abs(d.v)) / sqrt(abs(e.v)) AS v FROM a JOIN a d ON d.i = a.i AND d.i = d.j JOIN a e ON e.i = a.j AND e.i = e.j"),
    "mat_set_values": (lambda s, d: M.set_block(a(s, d), [0, 3], [1, 2], [[5.0, 6.0], [7.0, 8.0]]), "SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM a UNION ALL SELECT * FROM (VALUES (0, 1, 5.0), (0, 2, 6.0), (3, 1, 7.0), (3, 2, 8.0)) q(i, j, v)) GROUP BY 1, 2"),
    "mat_nnz": (lambda s, d: M.nnz(a(s, d)).select(F.col("value").cast("double").alias("value")), "SELECT count(*)::DOUBLE AS value FROM a"),
    "mat_size": (lambda s, d: M.shape(w(s, d)).select((F.col("n_rows") * 1000000 + F.col("n_cols")).cast("double").alias("value")), "SELECT ((max(i) + 1) * 1000000 + max(j) + 1)::DOUBLE AS value FROM w"),
    "mat_outside": (lambda s, d: M.outside(entries(s, d), 50).select("i", "j", "v"), "SELECT l_partkey AS i, l_suppkey AS j, l_quantity AS v FROM lineitem WHERE l_partkey >= 50 OR l_suppkey >= 50"),
    "diag_matvec": (lambda s, d: M.blocks_matvec(M.diagonal_blocks(a(s, d), 3), 3, z(s, d)), "SELECT a.i AS i, sum(a.v * z.v) AS v FROM a JOIN z ON a.j = z.i WHERE a.i // 3 = a.j // 3 GROUP BY 1"),
    "diag_matvech": (lambda s, d: M.blocks_matvec(M.diagonal_blocks(a(s, d), 3), 3, z(s, d), True), "SELECT a.j AS i, sum(a.v * z.v) AS v FROM a JOIN z ON a.i = z.i WHERE a.i // 3 = a.j // 3 GROUP BY 1"),
    "diag_scale": (lambda s, d: M.blocks_scale(1.5, M.diagonal_blocks(a(s, d), 3)), "SELECT i // 3 AS block, i % 3 AS r, j % 3 AS c, 1.5 * v AS v FROM a WHERE i // 3 = j // 3"),
    "diag_inverse": (lambda s, d: M.blocks_matvec(M.blocks_inverse(M.diagonal_blocks(a(s, d), 3), 3), 3, M.blocks_matvec(M.diagonal_blocks(a(s, d), 3), 3, z(s, d))), "SELECT i, v FROM z"),
    "vec_copy": (lambda s, d: B.copy(z(s, d)), "SELECT i, v FROM z"),
    "vec_swap": (lambda s, d: B.axpy(1000.0, *B.swap(x(s, d), y(s, d))), "SELECT i, 1000 * y.v + x.v AS v FROM x JOIN y USING (i)"),
    "vec_size": (lambda s, d: B.size(x(s, d)).select(F.col("value").cast("double").alias("value")), "SELECT (max(i) + 1)::DOUBLE AS value FROM x"),
    "vec_get_value": (lambda s, d: B.get_value(x(s, d), 7), "SELECT i, v FROM x WHERE i = 7"),
    "vec_get_values": (lambda s, d: B.get_values(x(s, d), 5, 20), "SELECT i, v FROM x WHERE i >= 5 AND i < 25"),
    "vec_set_value": (lambda s, d: B.set_value(x(s, d), 3, 2.5), "SELECT i, CASE WHEN i = 3 THEN 2.5 ELSE v END AS v FROM x"),
    "vec_set_run": (lambda s, d: B.set_run(x(s, d), 4, [1.0, 2.0, 3.0], True), "SELECT i, v + CASE WHEN i BETWEEN 4 AND 6 THEN i - 3 ELSE 0 END AS v FROM x"),
    "vec_scatter_gather": (lambda s, d: B.gather(B.scatter(x(s, d), 4)), "SELECT i, v FROM x"),
    "vec_conjugate": (lambda s, d: B.conjugate(pairs(s, d)).select("i", (F.col("re") + 1000 * F.col("im")).alias("v")), "SELECT i, x.v - 1000 * y.v AS v FROM x JOIN y USING (i)"),
    "vec_nhdot": (lambda s, d: B.nhdot(x(s, d), y(s, d)), "SELECT sum(x.v * y.v) AS value FROM x JOIN y USING (i)"),
    "vec_complex_dot": (lambda s, d: B.complex_dot(pairs(s, d), pairs(s, d)).select(F.col("re").alias("value")), "SELECT sum(x.v * x.v + y.v * y.v) AS value FROM x JOIN y USING (i)"),
    "vec_complex_nhdot": (lambda s, d: B.complex_dot(pairs(s, d), pairs(s, d), False).select((F.col("re") + F.col("im")).alias("value")), "SELECT sum(x.v * x.v - y.v * y.v + 2 * x.v * y.v) AS value FROM x JOIN y USING (i)"),
    "to_coo": (w, "SELECT i, j, v FROM w"),
    "to_csr": (lambda s, d: M.to_csr(w(s, d)), "SELECT row_number() OVER (ORDER BY i, j) - 1 AS pos, i, j, v FROM w"),
    "to_csc": (lambda s, d: M.to_csc(w(s, d)), "SELECT row_number() OVER (ORDER BY j, i) - 1 AS pos, i, j, v FROM w"),
    "to_msr": (lambda s, d: M.to_msr(a(s, d)), "SELECT CASE WHEN i = j THEN 0 ELSE 1 END AS part, i, j, v FROM a"),
    "to_dia": (lambda s, d: M.to_dia(a(s, d)), "SELECT j - i AS \"offset\", i, v FROM a"),
    "to_jad": (lambda s, d: M.to_jad(w(s, d)), "SELECT perm, row_number() OVER (PARTITION BY w.i ORDER BY j) - 1 AS slot, w.i, j, v FROM w JOIN (SELECT i, row_number() OVER (ORDER BY count(*) DESC, i) - 1 AS perm FROM w GROUP BY i) p ON w.i = p.i"),
    "to_bsr": (lambda s, d: M.to_bsr(a(s, d)), "SELECT i // 2 AS bi, j // 2 AS bj, i % 2 AS r, j % 2 AS c, v FROM a"),
}


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """A complex vector: prices with sizes as imaginary parts."""
    return x(spark, d).withColumnRenamed("v", "re").join(y(spark, d).withColumnRenamed("v", "im"), "i")


def updates(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000 + F.col("l_quantity")).alias("seq"), F.col("l_partkey").alias("i"), F.col("l_quantity").alias("v"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000 + F.col("l_quantity")).alias("seq"), F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_quantity").alias("v"))


def count(spark: SparkSession, d: str) -> int:
    return spark.read.parquet(f"{d}/supplier.parquet").count()


def vector_frame(spark: SparkSession, x: np.ndarray) -> DataFrame:
    if np.iscomplexobj(x):
        return spark.createDataFrame([(i, float(v.real), float(v.imag)) for i, v in enumerate(x)], "i long, re double, im double")
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double")


#: Methods for symmetric matrices, which solve with H; the others with A. cocg and cocr solve with H + i diag.
SYMMETRIC = {"cg", "cr", "minres", "cocg", "cocr"}
WITH_PRECON = {"cg": [p for p in preconditioners.BUILDERS if p not in ("none", "hybrid", "ilut", "iluc", "is")], "bicgstab": ["jacobi", "ssor", "iluk", "ilut"], "bicg": ["jacobi", "ssor", "iluk", "ilut", "sainv"], "gmres": [p for p in preconditioners.BUILDERS if p not in ("none", "hybrid")], "fgmres": ["hybrid"]}


def solved(method: str, precon: str = "none", limit: int | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """Solves a system over suppliers whose answer is 1 + i mod 7; limit 0 works over row blocks."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        n = count(spark, d)
        m = operator((h if method in SYMMETRIC else a)(spark, d), n) if limit is None else operator((h if method in SYMMETRIC else a)(spark, d), n, limit)
        u = known(n)
        if method in ("cocg", "cocr"):
            m, u = LocalOperator(m.i, m.j, m.v + 0.5j * m.v * (m.i == m.j), n), u + 1j * known(n)[::-1]
        found = solvers.solve(m, m.dot(u), method, precon, tol=1e-11, maxiter=2000, **({"omega": 1.1} if method == "sor" else {}))
        return vector_frame(spark, found.x)

    return query


def triangular(part: str, adjoint: bool) -> Callable[[SparkSession, str], DataFrame]:
    """Solves with a triangle of A, or with the product of both, for the right-hand side of the known answer."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        n = count(spark, d)
        m = operator(a(spark, d), n)
        i, j, v = m.entries()
        side = lambda keep: LocalOperator(i[keep], j[keep], v[keep], n)
        low, up, u = side(i >= j), side(i <= j), known(n)
        if part == "s":
            b = up.dot_h(low.dot_h(u) / m.diagonal()) if adjoint else low.dot(up.dot(u) / m.diagonal())
        else:
            t = low if part == "l" else up
            b = t.dot_h(u) if adjoint else t.dot(u)
        return vector_frame(spark, preconditioners.triangular_solve(m, b, part, adjoint))

    return query


def eigenvalues(method: str, n_values: int) -> Callable[[SparkSession, str], DataFrame]:
    """Of E, or of the pencil (L E L, L L) with L = diag(1 + i mod 3), which has the same ones."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        n = count(spark, d)
        m, b = operator(spectral(spark, d), n), None
        if method[0] == "g":
            scale, at = 1.0 + np.arange(n) % 3, np.arange(n)
            m, b = LocalOperator(m.i, m.j, m.v * scale[m.i] * scale[m.j], n), LocalOperator(at, at, scale**2, n)
        found = solvers.eigen(m, method, tol=1e-8, maxiter=20_000, count=n_values, b=b)
        return spark.createDataFrame([(k, float(np.real(v)), bool(s == solvers.SUCCESS)) for k, (v, s) in enumerate(zip(found.values, found.status))], "mode int, evalue double, converged boolean")

    return query


def eigenvector(spark: SparkSession, d: str) -> DataFrame:
    """Length of the vector of the smallest eigenvalue, and whether A x = l x holds."""
    m = operator(spectral(spark, d), count(spark, d))
    found = solvers.eigen(m, "li", count=1)
    x, lam = found.vectors[:, 0], found.values[0]
    return spark.createDataFrame([(float(np.linalg.norm(x)), bool(np.linalg.norm(m.dot(x) - lam * x) < 1e-6 * lam))], "length double, holds boolean")


SEVERAL_VALUES = {"si": 3, "li": 3, "ai": 3, "gsi": 3, "gli": 3, "gai": 3}
EIGEN = {k: SEVERAL_VALUES.get(k, 1) for k in options.EIGENSOLVERS if k}


def report(spark: SparkSession, d: str) -> DataFrame:
    """Status of solves by option strings, whether the first residual of the history is 1 and the last within the tolerance."""
    n = count(spark, d)
    m, s = operator(a(spark, d), n), operator(h(spark, d), n)
    rows = []
    for text in STRINGS:
        op = s if "-i cg" in text else m
        found = options.run(op, op.dot(known(n)), text)
        rows.append((text, options.STATUS[found.status], found.method, found.precon, bool(not found.history or found.history[0] == 1.0 or "nrm1_b" in text), bool(np.abs(found.x - known(n)).max() < 1e-4)))
    return spark.createDataFrame(rows, "options string, status string, method string, precon string, starts boolean, right boolean")


STRINGS = {"-i cg -p ssor -ssor_omega 1.2": ("cg", "ssor"), "-i 4 -p ilut -tol 1e-10": ("bicgstab", "ilut"), "-i gmres -restart 20 -p iluk -ilu_fill 1": ("gmres", "iluk"), "-i bicg -conv_cond nrm2_b": ("bicg", "none"), "-i bicgstab -conv_cond nrm1_b -tol_w 1e-11 -tol 0": ("bicgstab", "none"), "-i fgmres -p hybrid -hybrid_i gmres": ("fgmres", "hybrid"), "-i gpbicg -scale jacobi": ("gpbicg", "none"), "-i tfqmr -scale symm_diag": ("tfqmr", "none"), "-i gmres -p ssor -adds true": ("gmres", "adds"), "-i bicg -f quad": ("bicg", "none")}


def quad_toeplitz(spark: SparkSession, d: str) -> DataFrame:
    """BiCG in double-double on the Toeplitz system of order 200 that plain doubles can't solve."""
    m = operator(toeplitz(spark, 200, 2.0), 200)
    x, k, _ = dd.bicg(dd.QuadOperator(*m.entries(), 200), dd.Quad(m.dot(np.ones(200))))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x.hi + x.lo)], "i long, v double")


def quads(operate: Callable[[dd.Quad, dd.Quad], dd.Quad]) -> Callable[[SparkSession, str], DataFrame]:
    """An operation on nations' balances as Quads, the second operand with low words."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        sums = spark.read.parquet(f"{d}/customer.parquet").groupBy(F.col("c_nationkey").alias("i")).agg(F.round(F.sum("c_acctbal"), 2).alias("v"), F.count("*").alias("n")).toPandas().sort_values("i")  # a row for a nation
        found = operate(dd.Quad(sums["v"].to_numpy(float)), dd.Quad(sums["n"].to_numpy(float), 1e-20))
        hi = np.broadcast_to(found.hi + found.lo, len(sums)) if np.ndim(found.hi) else np.full(len(sums), float(found))
        return spark.createDataFrame([(int(i), float(v)) for i, v in zip(sums["i"], hi)], "i long, v double")

    return query


QSQL = "(SELECT c_nationkey AS i, round(sum(c_acctbal), 2) AS x, count(*)::DOUBLE AS n FROM customer GROUP BY 1)"
QUADS: dict[str, tuple[Callable, str]] = {
    "add": (lambda x, y: x + y, "x + n"), "sub": (lambda x, y: x - y, "x - n"), "mul": (lambda x, y: x * y, "x * n"), "div": (lambda x, y: x / y, "x / n"), "sqr": (lambda x, y: y.square(), "n * n"),
    "sqrt": (lambda x, y: y.sqrt(), "sqrt(n)"), "minus": (lambda x, y: -x, "-x"), "zero": (lambda x, y: x * dd.ZERO, "0.0"), "one": (lambda x, y: y * dd.ONE, "n"), "max": (lambda x, y: x.maximum(y), "greatest(x, n)"), "min": (lambda x, y: x.minimum(y), "least(x, n)"),
    "axpy": (lambda x, y: dd.axpy(dd.Quad(2.0, 1e-18), x, y), "2 * x + n"), "xpay": (lambda x, y: dd.xpay(x, 3.0, y), "x + 3 * n"), "scale": (lambda x, y: dd.scale(1.5, x), "1.5 * x"), "set_all": (lambda x, y: dd.set_all(7.0, x.hi.size), "7.0"), "reciprocal": (lambda x, y: dd.reciprocal(y), "1 / n"), "copy": (lambda x, y: dd.copy(x), "x"),
    "dot": (dd.dot, f"(SELECT sum(x * n) FROM {QSQL})"), "nrm2": (lambda x, y: dd.nrm2(x), f"(SELECT sqrt(sum(x * x)) FROM {QSQL})"),
}


def quad_product(adjoint: bool) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        n = count(spark, d)
        q = dd.QuadOperator(*operator(a(spark, d), n).entries(), n)
        found = (q.dot_h if adjoint else q.dot)(dd.Quad(known(n), 1e-18))
        return vector_frame(spark, found.hi + found.lo)

    return query


def dense_trade(spark: SparkSession, d: str) -> np.ndarray:
    """T as an array: a nation has a row, so its size doesn't grow."""
    n = spark.read.parquet(f"{d}/nation.parquet").count()
    return operator(trade(spark, d), n).dense()


def kernel(run: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Callable[[SparkSession, str], DataFrame]:
    """run(T, u, t) with u = 1 + i mod 7 and t the first column of T; a vector, a matrix or a number."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        t = dense_trade(spark, d)
        found = np.asarray(run(t, known(t.shape[0]), t[:, 0].copy()))
        if found.ndim == 2:
            return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(found)], "i long, j long, v double")
        return vector_frame(spark, found) if found.ndim else spark.createDataFrame([(float(found),)], "value double")

    return query


COLUMN = "(SELECT n_nationkey AS i, coalesce(t.v, 0) AS t, u.v AS u FROM nation JOIN u ON u.i = n_nationkey LEFT JOIN t ON t.i = n_nationkey AND t.j = 0)"
ROOM = "(SELECT p.n_nationkey AS i, q.n_nationkey AS j, coalesce(t.v, 0) AS v FROM nation p JOIN nation q ON true LEFT JOIN t ON t.i = p.n_nationkey AND t.j = q.n_nationkey)"
heavy = lambda t: t + 2 * np.abs(t).sum() / t.shape[0] * np.eye(t.shape[0])
UNIT = f"SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM {ROOM}"
KERNELS: dict[str, tuple[Callable, str]] = {
    "swap": (lambda t, u, c: dense.swap(u, c)[0], f"SELECT i, t AS v FROM {COLUMN}"), "copy": (lambda t, u, c: dense.copy(c), f"SELECT i, t AS v FROM {COLUMN}"), "axpy": (lambda t, u, c: dense.axpy(2.0, c, u), f"SELECT i, 2 * t + u AS v FROM {COLUMN}"), "xpay": (lambda t, u, c: dense.xpay(c, 3.0, u), f"SELECT i, t + 3 * u AS v FROM {COLUMN}"),
    "axpyz": (lambda t, u, c: dense.axpyz(-1.0, c, u, np.zeros_like(u)), f"SELECT i, u - t AS v FROM {COLUMN}"), "scale": (lambda t, u, c: dense.scale(1.5, c), f"SELECT i, 1.5 * t AS v FROM {COLUMN}"), "pmul": (lambda t, u, c: dense.pmul(c, u), f"SELECT i, t * u AS v FROM {COLUMN}"), "pdiv": (lambda t, u, c: dense.pdiv(c, u), f"SELECT i, t / u AS v FROM {COLUMN}"),
    "set_all": (lambda t, u, c: dense.set_all(4.0, u.size), f"SELECT i, 4.0::DOUBLE AS v FROM {COLUMN}"), "abs": (lambda t, u, c: dense.absolute(-c), f"SELECT i, abs(t) AS v FROM {COLUMN}"), "reciprocal": (lambda t, u, c: dense.reciprocal(u), f"SELECT i, 1 / u AS v FROM {COLUMN}"), "conjugate": (lambda t, u, c: dense.conjugate(c + 1j * u).imag, f"SELECT i, -u AS v FROM {COLUMN}"),
    "shift": (lambda t, u, c: dense.shift(10.0, c), f"SELECT i, t - 10 AS v FROM {COLUMN}"), "dot": (lambda t, u, c: dense.dot(c, u), f"SELECT sum(t * u) AS value FROM {COLUMN}"), "nhdot": (lambda t, u, c: dense.nhdot(c + 1j * u, c + 1j * u).real, f"SELECT sum(t * t - u * u) AS value FROM {COLUMN}"), "nrm1": (lambda t, u, c: dense.nrm1(c), f"SELECT sum(abs(t)) AS value FROM {COLUMN}"),
    "nrm2": (lambda t, u, c: dense.nrm2(c), f"SELECT sqrt(sum(t * t)) AS value FROM {COLUMN}"), "nrmi": (lambda t, u, c: dense.nrmi(c), f"SELECT max(abs(t)) AS value FROM {COLUMN}"), "sum": (lambda t, u, c: dense.total(c), f"SELECT sum(t) AS value FROM {COLUMN}"),
    "matvec": (lambda t, u, c: dense.matvec(t, u, c, "add"), f"SELECT r.i, c.t + sum(r.v * u.v) AS v FROM {ROOM} r JOIN u ON r.j = u.i JOIN {COLUMN} c ON c.i = r.i GROUP BY r.i, c.t"), "matvech": (lambda t, u, c: dense.matvech(t, u, c, "sub"), f"SELECT r.j AS i, c.t - sum(r.v * u.v) AS v FROM {ROOM} r JOIN u ON r.i = u.i JOIN {COLUMN} c ON c.i = r.j GROUP BY r.j, c.t"),
    "matvec_ns": (lambda t, u, c: dense.matvec(t[:4], u), f"SELECT r.i, sum(r.v * u.v) AS v FROM {ROOM} r JOIN u ON r.j = u.i WHERE r.i < 4 GROUP BY 1"), "matmat": (lambda t, u, c: dense.matmat(t, t), f"SELECT p.i, q.j, sum(p.v * q.v) AS v FROM {ROOM} p JOIN {ROOM} q ON p.j = q.i GROUP BY 1, 2"), "matmat_ns": (lambda t, u, c: dense.matmat(t[:3], t[:, :2]), f"SELECT p.i, q.j, sum(p.v * q.v) AS v FROM {ROOM} p JOIN {ROOM} q ON p.j = q.i WHERE p.i < 3 AND q.j < 2 GROUP BY 1, 2"),
    "ge": (lambda t, u, c: dense.inverse(heavy(t)) @ heavy(t), UNIT), "solve": (lambda t, u, c: dense.lu_solve(heavy(t), heavy(t) @ u), "SELECT i, v FROM u"), "cgs": (lambda t, u, c: (lambda q: q.T @ q)(dense.gram_schmidt(heavy(t), False)[0]), UNIT), "mgs": (lambda t, u, c: (lambda q, r: q @ r)(*dense.gram_schmidt(heavy(t))), f"SELECT r.i, r.j, r.v + CASE WHEN r.i = r.j THEN (SELECT 2 * sum(v) / (SELECT count(*) FROM nation) FROM t) ELSE 0 END AS v FROM {ROOM} r"),
    "qr": (lambda t, u, c: np.trace(dense.qr_iteration(heavy(t + t.T), 1e-9, 3000)[0]), "SELECT sum(CASE WHEN i = j THEN 2 * v ELSE 0 END) + 4 * sum(v) AS value FROM t"),
}


def stored(name: str, product: bool) -> Callable[[SparkSession, str], DataFrame]:
    """A through a format and back, or its product with the balances."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        packed = storage.pack(a(spark, d), count(spark, d), name)
        return storage.spmv(packed, name, z(spark, d)) if product else storage.unpack(packed, name)

    return query


def through_file(form: str) -> Callable[[SparkSession, str], DataFrame]:
    """A, its product with the known vector, or the balances, written to a file and read again."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        n, path = count(spark, d), f"{folder(spark)}/{form}"
        if form in ("vector_mm", "vector_plain"):
            matrix_market.write_vector(z(spark, d), n, path, form.split("_")[1])
            return matrix_market.read_vector(spark, path)[0]
        if form == "mm_array":
            matrix_market.write_array(a(spark, d), n, path)
            return matrix_market.read(spark, path)[0].where("v <> 0")
        if form == "hb":
            m = operator(a(spark, d), n)  # the format is one stream: a matrix beyond the operator's limit is refused
            if not isinstance(m, LocalOperator):
                raise ValueError("too large for a Harwell-Boeing file")
            lines = harwell_boeing.text(list(zip(m.i.tolist(), m.j.tolist(), m.v.tolist())), n, m.dot(known(n)).tolist())
            spark.createDataFrame([(lines,)], "value string").coalesce(1).write.mode("overwrite").text(path)
            return harwell_boeing.read(spark, path)[0]
        matrix_market.write(a(spark, d), n, path, z(spark, d), z(spark, d))
        entries, _, b, x = matrix_market.read(spark, path)
        return entries if form == "mm" else B.axpy(2.0, b, x)

    return query


FILES = {"mm": "SELECT i, j, v FROM a", "mm_vectors": "SELECT i, 3 * v AS v FROM z", "mm_array": "SELECT i, j, v FROM a", "vector_mm": "SELECT i, v FROM z", "vector_plain": "SELECT i, v FROM z", "hb": "SELECT i, j, v FROM a"}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return rounded(solved("cg")(spark, d), 6)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, (f, _) in TABLE.items()}
    found |= {f"solve_{k}": solved(k) for k in solvers.METHODS}
    found |= {f"solve_{k}_{p}": solved(k, p) for k, ps in WITH_PRECON.items() for p in ps}
    found |= {f"solve_{k}_blocks": solved(k, p, 0) for k, p in (("cg", "jacobi"), ("bicgstab", "bjacobi"))}
    found |= {f"mat_solve{'h' * t}_{p}": triangular(p, t) for p in "lus" for t in (False, True)}
    found |= {f"eig_{k}": eigenvalues(k, n) for k, n in EIGEN.items()} | {"eig_vector": eigenvector, "solve_options": report}
    found |= {f"arr_{k}": kernel(f) for k, (f, _) in KERNELS.items()}
    found |= {f"quad_{k}": quads(f) for k, (f, _) in QUADS.items()} | {"quad_matvec": quad_product(False), "quad_matvech": quad_product(True), "quad_bicg": quad_toeplitz}
    found |= {f"pack_{k}": stored(k, False) for k in storage.FORMATS} | {f"spmv_{k}": stored(k, True) for k in storage.FORMATS}
    found |= {f"file_{k}": through_file(k) for k in FILES}
    return {name: (lambda s, d, f=f: rounded(f(s, d))) for name, f in found.items()}


def oracle_sql() -> dict[str, str]:
    def wrapped(select: str, *names: str) -> str:
        names = names or (("value",) if "AS value" in select else ("v",))
        return f"{WITH} SELECT * REPLACE ({', '.join(f'round({k}, 4) + 0.0 AS {k}' for k in names)}) FROM ({select})"

    found = {name: wrapped(sql) for name, (_, sql) in TABLE.items()}
    answer = "SELECT s_suppkey AS i, CAST(1 + s_suppkey % 7 AS DOUBLE) AS v FROM supplier"
    found |= {f"solve_{k}": answer for k in solvers.METHODS} | {f"solve_{k}_{p}": answer for k, ps in WITH_PRECON.items() for p in ps} | {f"solve_{k}_blocks": answer for k in ("cg", "bicgstab")}
    turned = "SELECT s_suppkey AS i, CAST(1 + s_suppkey % 7 AS DOUBLE) AS re, CAST(1 + ((SELECT max(s_suppkey) FROM supplier) - s_suppkey) % 7 AS DOUBLE) AS im FROM supplier"
    found |= {"solve_cocg": turned, "solve_cocr": turned} | {f"mat_solve{'h' * t}_{p}": answer for p in "lus" for t in (0, 1)}
    for k, n in EIGEN.items():
        order = "DESC" if k in ("pi", "gpi") else "ASC"
        found[f"eig_{k}"] = f"SELECT CAST(row_number() OVER (ORDER BY e {order}) - 1 AS INTEGER) AS mode, round(e, 4) + 0.0 AS evalue, true AS converged FROM (SELECT CAST(s_acctbal + 1001 AS DOUBLE) AS e FROM supplier ORDER BY e {order} LIMIT {n})"
    found["eig_vector"] = "SELECT 1.0::DOUBLE AS length, true AS holds"
    found["solve_options"] = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', 'normal end', '{m}', '{p}', true, true)" for k, (m, p) in STRINGS.items()) + ") q(options, status, method, precon, starts, \"right\")"
    found |= {f"arr_{k}": wrapped(sql) for k, (_, sql) in KERNELS.items()}
    found |= {f"quad_{k}": f"SELECT i, round({sql}, 4) + 0.0 AS v FROM {QSQL}" for k, (_, sql) in QUADS.items()}
    product = "SELECT a.{} AS i, sum(a.v * (1 + a.{} % 7)) AS v FROM a GROUP BY 1"
    found |= {"quad_matvec": wrapped(product.format("i", "j")), "quad_matvech": wrapped(product.format("j", "i")), "quad_bicg": "SELECT CAST(i AS BIGINT) AS i, 1.0::DOUBLE AS v FROM (SELECT unnest(range(200)) AS i)"}
    found |= {f"pack_{k}": wrapped("SELECT i, j, v FROM a") for k in storage.FORMATS}
    found |= {f"spmv_{k}": wrapped("SELECT a.i AS i, sum(a.v * z.v) AS v FROM a JOIN z ON a.j = z.i GROUP BY 1") for k in storage.FORMATS}
    return found | {f"file_{k}": wrapped(sql) for k, sql in FILES.items()}
