"""Registered queries, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.algebra import BINARY, INFINITY, LARGEST, MONOID, SEMIRING, BinaryOp, Monoid, UnaryOp
from lattica.operators import elementwise as ew
from lattica.operators import products as pr
from lattica.operators import structure as st
from lattica.operators.objects import Descriptor, Matrix, Vector
from lattica.plans import algorithms as alg
from lattica.plans import graphs as g
from lattica.plans import verify
from lattica.sources.matrix_market import UNDIRECTED, load, read_mtx, save, write_mtx
from lattica.store import cut, scratch
from lattica.streaming.ingest import current, ingest_edges

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
COMPLEMENT = Descriptor(complement=True)


def _with(names: str, sql: str, recursive: bool = False) -> str:
    heads = ", ".join(f"{n} AS ({g.SQL[n]})" for n in names.split())
    return f"WITH {'RECURSIVE ' * recursive}{heads}{', ' if not sql.lstrip().startswith('SELECT') else ' '}{sql}"


def query(name: str, names: str, sql: str, recursive: bool = False):
    """Register a function (spark, sf) that gives a DataFrame, Vector or Matrix."""

    def keep(f):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            out = f(spark, sf)
            return out.df if isinstance(out, (Vector, Matrix)) else out

        QUERIES[name] = run
        ORACLE_SQL[name] = _with(names, sql, recursive) if names else sql
        return f

    return keep


def _each(name: str, names: str, sql: str, f) -> None:
    query(name, names, sql)(f)


# Objects

@query("build_dup_plus", "", "SELECT l_partkey AS i, l_suppkey AS j, CAST(sum(l_linenumber) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    return Matrix.of(_lines(spark, sf), *g.shape_ps(spark, sf), dup=MONOID["plus"])


@query("build_dup_min", "", "SELECT l_partkey AS i, l_suppkey AS j, CAST(min(l_linenumber) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    return Matrix.of(_lines(spark, sf), *g.shape_ps(spark, sf), dup=BINARY["minimum"])


def _lines(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_linenumber").alias("v"))


@query("extract_tuples", "nat", "SELECT * FROM nat")
def _(spark, sf):
    return g.nat(spark, sf)


@query("fill_ascending", "", "SELECT s_suppkey AS i, s_suppkey AS v FROM supplier")
def _(spark, sf):
    return Vector.ascending(spark, g.sv(spark, sf).size)


@query("fill_constant", "", "SELECT s_suppkey AS i, 7::BIGINT AS v FROM supplier")
def _(spark, sf):
    return Vector.fill(spark, g.sv(spark, sf).size, 7)


@query("set_element", "sv", "SELECT i, CASE WHEN i = 3 THEN 99 ELSE v END AS v FROM sv")
def _(spark, sf):
    return g.sv(spark, sf).set_element(3, 99)


@query("set_element_matrix", "nat", "SELECT i, j, CASE WHEN i = 1 AND j = 2 THEN 5 ELSE v END AS v FROM nat UNION SELECT 1, 2, 5")
def _(spark, sf):
    return g.nat(spark, sf).set_element(1, 2, 5)


@query("count_unique", "pv", "SELECT count(DISTINCT v) AS v FROM pv")
def _(spark, sf):
    return g.pv(spark, sf).df.agg(F.count_distinct("v").alias("v"))


@query("resize_vector", "pv", "SELECT * FROM pv WHERE i < 100")
def _(spark, sf):
    return g.pv(spark, sf).resize(100)


@query("resize_matrix", "nat", "SELECT * FROM nat WHERE i < 10 AND j < 7")
def _(spark, sf):
    return g.nat(spark, sf).resize(10, 7)


@query("to_dense", "sm", "SELECT s_suppkey AS i, coalesce(v, 0) AS v FROM supplier LEFT JOIN sm ON s_suppkey = i")
def _(spark, sf):
    return g.sm(spark, sf).to_dense(0)


@query("to_sparse", "sm", "SELECT * FROM sm WHERE v <> 0")
def _(spark, sf):
    return g.sm(spark, sf).to_sparse(0)


# Products

def _divided(c: str) -> str:
    return f"round({c}, 6)"


_VXM = {
    "vxm_plus_times": ("plus_times", "sum(p.v * a.v)::BIGINT"),
    "vxm_min_plus": ("min_plus", "min(p.v + a.v)"),
    "vxm_max_times": ("max_times", "greatest(0, max(p.v * a.v))"),
    "vxm_or_and": ("or_and", "max(CASE WHEN p.v <> 0 AND a.v <> 0 THEN 1 ELSE 0 END)::BIGINT"),
    "vxm_plus_greater": ("plus_greater", "sum(CASE WHEN p.v > a.v THEN 1 ELSE 0 END)::BIGINT"),
    "vxm_plus_less": ("plus_less", "sum(CASE WHEN p.v < a.v THEN 1 ELSE 0 END)::BIGINT"),
    "vxm_min_times": ("min_times", "min(p.v * a.v)"),
    "vxm_plus_not_equal": ("plus_not_equal", "sum(CASE WHEN p.v <> a.v THEN 1 ELSE 0 END)::BIGINT"),
    "vxm_min_not_equal": ("min_not_equal", "min(CASE WHEN p.v <> a.v THEN 1 ELSE 0 END)::BIGINT"),
}
for _name, (_ring, _expr) in _VXM.items():
    _each(_name, "ps pv", f"SELECT a.j AS i, CAST({_expr} AS BIGINT) AS v FROM pv p JOIN ps a ON p.i = a.i GROUP BY a.j", lambda spark, sf, r=_ring: _long(pr.vxm(g.pv(spark, sf), g.ps(spark, sf), SEMIRING[r])))


def _long(x: Vector | Matrix):
    return x.df.withColumn("v", F.col("v").cast("long"))


_MXV = {
    "mxv_plus_times": ("plus_times", "sum(a.v * s.v)"),
    "mxv_min_second": ("min_second", "min(s.v)"),
    "mxv_plus_minus": ("plus_minus", "sum(a.v - s.v)"),
}
for _name, (_ring, _expr) in _MXV.items():
    _each(_name, "ps sv", f"SELECT a.i, CAST({_expr} AS BIGINT) AS v FROM ps a JOIN sv s ON s.i = a.j GROUP BY a.i", lambda spark, sf, r=_ring: _long(pr.mxv(g.ps(spark, sf), g.sv(spark, sf), SEMIRING[r])))


@query("mxv_plus_divides", "ps sv", "SELECT a.i, round(sum(a.v / s.v), 4) AS v FROM ps a JOIN sv s ON s.i = a.j GROUP BY a.i")
def _(spark, sf):
    return pr.mxv(g.ps(spark, sf), g.sv(spark, sf), SEMIRING["plus_divides"]).df.withColumn("v", F.round("v", 4))


@query("vxm_times_times", "nat", "SELECT j AS i, round(ln(product(2 * v)), 6) AS v FROM nat GROUP BY j")
def _(spark, sf):
    a = g.nat(spark, sf)
    return pr.vxm(Vector.fill(spark, a.nrows, 2), a, SEMIRING["times_times"]).df.withColumn("v", F.round(F.log("v"), 6))


@query("vxm_masked", "ps pv sm", "SELECT a.j AS i, CAST(sum(p.v * a.v) AS BIGINT) AS v FROM pv p JOIN ps a ON p.i = a.i WHERE a.j IN (SELECT i FROM sm WHERE v <> 0) GROUP BY a.j")
def _(spark, sf):
    return pr.vxm(g.pv(spark, sf), g.ps(spark, sf), SEMIRING["plus_times"], mask=g.sm(spark, sf))


@query("vxm_complement_mask", "ps pv sm", "SELECT a.j AS i, CAST(sum(p.v * a.v) AS BIGINT) AS v FROM pv p JOIN ps a ON p.i = a.i WHERE a.j NOT IN (SELECT i FROM sm WHERE v <> 0) GROUP BY a.j")
def _(spark, sf):
    return pr.vxm(g.pv(spark, sf), g.ps(spark, sf), SEMIRING["plus_times"], mask=g.sm(spark, sf), desc=COMPLEMENT)


@query("vxm_transposed", "ps sv", "SELECT a.i, CAST(sum(a.v * s.v) AS BIGINT) AS v FROM ps a JOIN sv s ON s.i = a.j GROUP BY a.i")
def _(spark, sf):
    return pr.vxm(g.sv(spark, sf), g.ps(spark, sf), SEMIRING["plus_times"], desc=Descriptor(tran1=True))


@query("vxm_push", "ps sm", "SELECT a.i, CAST(sum(a.v * s.v) AS BIGINT) AS v FROM ps a JOIN sm s ON s.i = a.j GROUP BY a.i")
def _(spark, sf):
    return pr.mxv(g.ps(spark, sf), g.sm(spark, sf), SEMIRING["plus_times"], desc=Descriptor(mode="push"))


@query("vxm_pull", "ps sm", "SELECT a.i, CAST(sum(a.v * s.v) AS BIGINT) AS v FROM ps a JOIN sm s ON s.i = a.j GROUP BY a.i")
def _(spark, sf):
    return pr.mxv(g.ps(spark, sf), g.sm(spark, sf), SEMIRING["plus_times"], desc=Descriptor(mode="pull"))


@query("apply_vxm", "ps pv", "SELECT a.j AS i, CAST(sum(-p.v * a.v) AS BIGINT) AS v FROM pv p JOIN ps a ON p.i = a.i GROUP BY a.j")
def _(spark, sf):
    return pr.apply_vxm(UnaryOp("negate", lambda c: -c), g.pv(spark, sf), g.ps(spark, sf), SEMIRING["plus_times"])


_MXV_T = "t AS (SELECT a.i, CAST(sum(a.v * s.v) AS BIGINT) AS v FROM ps a JOIN sm s ON s.i = a.j WHERE a.i IN (SELECT i FROM pm WHERE v <> 0) GROUP BY a.i)"


@query("mxv_accum", "ps pv pm sm", f"{_MXV_T} SELECT coalesce(p.i, t.i) AS i, CASE WHEN p.v IS NULL THEN t.v WHEN t.v IS NULL THEN p.v ELSE p.v + t.v END AS v FROM pv p FULL JOIN t ON p.i = t.i")
def _(spark, sf):
    return pr.mxv(g.ps(spark, sf), g.sm(spark, sf), SEMIRING["plus_times"], mask=g.pm(spark, sf), accum=BINARY["plus"], w=g.pv(spark, sf))


@query("mxv_replace", "ps pv pm sm", f"{_MXV_T}, o AS (SELECT * FROM pv WHERE i IN (SELECT i FROM pm WHERE v <> 0)) SELECT coalesce(p.i, t.i) AS i, CASE WHEN p.v IS NULL THEN t.v WHEN t.v IS NULL THEN p.v ELSE p.v + t.v END AS v FROM o p FULL JOIN t ON p.i = t.i")
def _(spark, sf):
    return pr.mxv(g.ps(spark, sf), g.sm(spark, sf), SEMIRING["plus_times"], mask=g.pm(spark, sf), accum=BINARY["plus"], w=g.pv(spark, sf), desc=Descriptor(replace=True))


@query("mxv_masked_keeps", "ps pv pm sm", f"{_MXV_T} SELECT i, v FROM t UNION ALL SELECT i, v FROM pv WHERE i NOT IN (SELECT i FROM pm WHERE v <> 0)")
def _(spark, sf):
    return pr.mxv(g.ps(spark, sf), g.sm(spark, sf), SEMIRING["plus_times"], mask=g.pm(spark, sf), w=g.pv(spark, sf))


@query("mxv_masked_replaces", "ps pv pm sm", f"{_MXV_T} SELECT i, v FROM t")
def _(spark, sf):
    return pr.mxv(g.ps(spark, sf), g.sm(spark, sf), SEMIRING["plus_times"], mask=g.pm(spark, sf), w=g.pv(spark, sf), desc=Descriptor().toggle("replace"))


@query("mxv_masked_complement_keeps", "ps pv pm sm", "t AS (SELECT a.i, CAST(sum(a.v * s.v) AS BIGINT) AS v FROM ps a JOIN sm s ON s.i = a.j WHERE a.i NOT IN (SELECT i FROM pm WHERE v <> 0) GROUP BY a.i) SELECT i, v FROM t UNION ALL SELECT i, v FROM pv WHERE i IN (SELECT i FROM pm WHERE v <> 0)")
def _(spark, sf):
    return pr.mxv(g.ps(spark, sf), g.sm(spark, sf), SEMIRING["plus_times"], mask=g.pm(spark, sf), w=g.pv(spark, sf), desc=COMPLEMENT.toggle("replace").toggle("replace"))


@query("reduce_row_custom", "ps", "SELECT i, max(v) AS v FROM ps GROUP BY i")
def _(spark, sf):
    return st.reduce_rows(g.ps(spark, sf), Monoid.custom("largest", BINARY["maximum"], 0), dense=False)


@query("reduce_mat_custom", "ps", "SELECT bit_xor(v) AS v FROM ps")
def _(spark, sf):
    return st.reduce_df(g.ps(spark, sf), Monoid.custom("parity", BinaryOp("xor", lambda a, b: a.bitwiseXOR(b)), 0))


@query("reduce_row_accum", "ps pv", "r AS (SELECT i, CAST(sum(v) AS BIGINT) AS v FROM ps GROUP BY i) SELECT coalesce(p.i, r.i) AS i, CASE WHEN p.v IS NULL THEN r.v WHEN r.v IS NULL THEN p.v ELSE least(p.v, r.v) END AS v FROM pv p FULL JOIN r ON p.i = r.i")
def _(spark, sf):
    return st.reduce_rows(g.ps(spark, sf), MONOID["plus"], accum=BINARY["minimum"], w=g.pv(spark, sf))


@query("apply_masked_accum", "pv pm", "SELECT i, CASE WHEN i IN (SELECT i FROM pm WHERE v <> 0) THEN v + 2 * v ELSE v END AS v FROM pv")
def _(spark, sf):
    v = g.pv(spark, sf)
    return ew.apply(UnaryOp("double", lambda c: 2 * c), v, mask=g.pm(spark, sf), accum=BINARY["plus"], w=v)


@query("transpose_accum", "ps ps2", "SELECT a.j AS i, a.i AS j, CAST(a.v + coalesce(b.v, 0) AS BIGINT) AS v FROM ps a LEFT JOIN ps2 b ON a.i = b.i AND a.j = b.j")
def _(spark, sf):
    return st.transpose(g.ps(spark, sf), accum=BINARY["plus"], C=g.ps2(spark, sf).T)


@query("mxm_plus_times", "hi", "SELECT a.i, b.j, count(*) AS v FROM hi a JOIN hi b ON a.j = b.i GROUP BY 1, 2")
def _(spark, sf):
    a = g.hi(spark, sf)
    return pr.mxm(a, a, SEMIRING["plus_times"])


_W = "w AS (SELECT i, j, 1 + (31 * i + 17 * j) % 64 AS v FROM hi)"


@query("mxm_min_plus", "hi", f"{_W} SELECT a.i, b.j, min(a.v + b.v) AS v FROM w a JOIN w b ON a.j = b.i GROUP BY 1, 2")
def _(spark, sf):
    a = g.hi(spark, sf, weighted=True)
    return _long(pr.mxm(a, a, SEMIRING["min_plus"]))


@query("mxm_masked", "users", "SELECT m.i, m.j, count(a.i) AS v FROM users m LEFT JOIN users a ON a.i = m.i LEFT JOIN users b ON b.i = a.j AND b.j = m.j WHERE a.i IS NULL OR b.i IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT m.i, m.j, 0 FROM users m WHERE NOT EXISTS (SELECT 1 FROM users a JOIN users b ON a.j = b.i WHERE a.i = m.i AND b.j = m.j)")
def _(spark, sf):
    a = g.users(spark, sf)
    return pr.mxm(a, a, SEMIRING["plus_times"], mask=a)


@query("mxm_transposed", "nat", "SELECT a.i, b.i AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM nat a JOIN nat b ON a.j = b.j GROUP BY 1, 2")
def _(spark, sf):
    a = g.nat(spark, sf)
    return pr.mxm(a, a, SEMIRING["plus_times"], desc=Descriptor(tran1=True))


@query("trace_mxm_transpose", "ps ps2", "SELECT CAST(sum(a.v * b.v) AS BIGINT) AS v FROM ps a JOIN ps2 b ON a.i = b.i AND a.j = b.j")
def _(spark, sf):
    return pr.trace_mxm_transpose_df(SEMIRING["plus_times"], g.ps(spark, sf), g.ps2(spark, sf))


@query("trace_mxm", "nat", "SELECT CAST(sum(a.v * b.v) AS BIGINT) AS v FROM nat a JOIN nat b ON a.i = b.j AND a.j = b.i")
def _(spark, sf):
    return pr.trace_mxm_df(SEMIRING["plus_times"], g.nat(spark, sf), g.nat(spark, sf))


# Element by element

@query("ewise_mult_vec", "sv sm", "SELECT i, a.v * b.v AS v FROM sv a JOIN sm b USING (i)")
def _(spark, sf):
    return ew.ewise_mult(g.sv(spark, sf), g.sm(spark, sf), SEMIRING["plus_times"])


@query("ewise_mult_masked", "pv pm", "SELECT i, v * v AS v FROM pv WHERE i IN (SELECT i FROM pm WHERE v <> 0)")
def _(spark, sf):
    return ew.ewise_mult(g.pv(spark, sf), g.pv(spark, sf), SEMIRING["plus_times"], mask=g.pm(spark, sf))


@query("ewise_mult_mat", "ps ps2", "SELECT i, j, a.v * b.v AS v FROM ps a JOIN ps2 b USING (i, j)")
def _(spark, sf):
    return ew.ewise_mult(g.ps(spark, sf), g.ps2(spark, sf), SEMIRING["plus_times"])


@query("ewise_mult_scalar", "ps", "SELECT i, j, v * 3 AS v FROM ps")
def _(spark, sf):
    return ew.ewise_mult(g.ps(spark, sf), 3, SEMIRING["plus_times"])


@query("ewise_mult_vec_scalar", "pv", "SELECT i, v * 3 AS v FROM pv")
def _(spark, sf):
    return ew.ewise_mult(g.pv(spark, sf), 3, SEMIRING["plus_times"])


@query("ewise_mult_broadcast_col", "ps pv", "SELECT a.i, a.j, a.v * p.v AS v FROM ps a JOIN pv p ON a.i = p.i")
def _(spark, sf):
    return ew.ewise_mult(g.ps(spark, sf), g.pv(spark, sf), SEMIRING["plus_times"])


@query("ewise_mult_broadcast_row", "ps sv", "SELECT a.i, a.j, a.v * s.v AS v FROM ps a JOIN sv s ON a.j = s.i")
def _(spark, sf):
    return ew.ewise_mult(g.ps(spark, sf), g.sv(spark, sf), SEMIRING["plus_times"], desc=Descriptor(tran1=True))


@query("ewise_add_vec", "sv sm", "SELECT coalesce(a.i, b.i) AS i, coalesce(a.v, 0) + coalesce(b.v, 0) AS v FROM sv a FULL JOIN sm b ON a.i = b.i")
def _(spark, sf):
    return ew.ewise_add(g.sv(spark, sf), g.sm(spark, sf), SEMIRING["plus_times"])


@query("ewise_add_min", "pv pm", "SELECT i, least(a.v, coalesce(b.v, a.v)) AS v FROM pv a LEFT JOIN pm b USING (i)")
def _(spark, sf):
    return _long(ew.ewise_add(g.pv(spark, sf), g.pm(spark, sf), MONOID["minimum"]))


@query("ewise_add_masked", "pv pm", "SELECT a.i, a.v + b.v AS v FROM pv a JOIN pm b ON a.i = b.i WHERE b.v <> 0")
def _(spark, sf):
    return ew.ewise_add(g.pv(spark, sf), g.pm(spark, sf), MONOID["plus"], mask=g.pm(spark, sf))


@query("ewise_add_scalar", "pv", "SELECT i, v + 10 AS v FROM pv")
def _(spark, sf):
    return ew.ewise_add(g.pv(spark, sf), 10, SEMIRING["plus_times"])


@query("ewise_add_mat", "ps ps2", "SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, coalesce(a.v, 0) + coalesce(b.v, 0) AS v FROM ps a FULL JOIN ps2 b ON a.i = b.i AND a.j = b.j")
def _(spark, sf):
    return ew.ewise_add(g.ps(spark, sf), g.ps2(spark, sf), SEMIRING["plus_times"])


@query("ewise_add_custom_less", "pv pm", f"SELECT i, CAST(a.v < coalesce(b.v, {INFINITY!r}) AS BIGINT) AS v FROM pv a LEFT JOIN pm b USING (i)")
def _(spark, sf):
    return ew.ewise_add(g.pv(spark, sf), g.pm(spark, sf), SEMIRING["custom_less_plus"])


@query("ewise_add_greater_plus", "pv pm", f"SELECT i, CAST(a.v > coalesce(b.v, 0) AS BIGINT) AS v FROM pv a LEFT JOIN pm b USING (i)")
def _(spark, sf):
    return ew.ewise_add(g.pv(spark, sf), g.pm(spark, sf), SEMIRING["greater_plus"])


@query("ewise_add_not_equal_plus", "pv pm", f"SELECT i, CAST(a.v <> coalesce(b.v, {INFINITY!r}) AS BIGINT) AS v FROM pv a LEFT JOIN pm b USING (i)")
def _(spark, sf):
    return ew.ewise_add(g.pv(spark, sf), g.pm(spark, sf), SEMIRING["not_equal_plus"])


@query("ewise_add_custom_less_less", "pv pm", f"SELECT i, CAST(a.v < coalesce(b.v, {INFINITY!r}) AS BIGINT) AS v FROM pv a LEFT JOIN pm b USING (i)")
def _(spark, sf):
    return ew.ewise_add(g.pv(spark, sf), g.pm(spark, sf), SEMIRING["custom_less_less"])


_BIN = {
    "logical_or": "a.v <> 0 OR b.v <> 0", "logical_and": "a.v <> 0 AND b.v <> 0", "logical_xor": "(a.v <> 0) <> (b.v <> 0)", "equal": "a.v = b.v", "not_equal_to": "a.v <> b.v",
    "greater": "a.v > b.v", "less": "a.v < b.v", "greater_equal": "a.v >= b.v", "less_equal": "a.v <= b.v", "first": "a.v", "second": "b.v", "minimum": "least(a.v, b.v)", "maximum": "greatest(a.v, b.v)", "minus": "a.v - b.v",
}
for _name, _expr in _BIN.items():
    _each(f"binary_{_name}", "sv sm", f"SELECT i, CAST({_expr} AS BIGINT) AS v FROM sv a JOIN sm b USING (i)", lambda spark, sf, n=_name: ew.ewise_mult(g.sv(spark, sf), g.sm(spark, sf), BINARY[n]))


@query("binary_divides", "sv sm", "SELECT i, CASE WHEN b.v = 0 THEN 'Infinity'::DOUBLE ELSE round(a.v / b.v, 6) END AS v FROM sv a JOIN sm b USING (i)")
def _(spark, sf):
    out = ew.ewise_mult(g.sv(spark, sf), g.sm(spark, sf), BINARY["divides"]).df
    return out.withColumn("v", F.when(F.col("v") == float("inf"), F.col("v")).otherwise(F.round("v", 6)))


# Reductions

_RED = {"plus": "sum(v)", "times": "round(ln(product(v)), 6)", "min": "min(v)", "max": "greatest(0, max(v))", "or": "max((v <> 0)::INT)", "and": "min((v <> 0)::INT)"}
_NONE = {"plus": "0", "times": "0.0", "min": str(LARGEST), "max": "0", "or": "0", "and": "1"}
_MON = {"plus": "plus", "times": "multiplies", "min": "minimum", "max": "maximum", "or": "logical_or", "and": "logical_and"}


def _shown(df: DataFrame, kind: str) -> DataFrame:
    """Products are shown as logarithms, all else as integers."""
    return df.withColumn("v", F.round(F.log("v"), 6) if kind == "times" else F.col("v").try_cast("long"))


for _kind, _expr in _RED.items():
    _sql = _expr if _kind == "times" else f"CAST({_expr} AS BIGINT)"
    _each(f"reduce_row_{_kind}", "nat", f"SELECT i, {_sql} AS v FROM nat GROUP BY i", lambda spark, sf, k=_kind: _shown(st.reduce_rows(g.nat(spark, sf), MONOID[_MON[k]], dense=False).df, k))
    _each(f"reduce_vec_{_kind}", "nat", f"SELECT coalesce({_sql}, {_NONE[_kind]}) AS v FROM nat WHERE j = 0", lambda spark, sf, k=_kind: _shown(st.reduce_df(st.extract_column(g.nat(spark, sf), None, 0), MONOID[_MON[k]]), k))
    if _kind != "times":
        _each(f"reduce_mat_{_kind}", "ps", f"SELECT {_sql} AS v FROM ps", lambda spark, sf, k=_kind: _shown(st.reduce_df(g.ps(spark, sf), MONOID[_MON[k]]), k))


@query("reduce_row", "ps2", "SELECT p_partkey AS i, CAST(coalesce(sum(v), 0) AS BIGINT) AS v FROM part LEFT JOIN ps2 ON i = p_partkey GROUP BY 1")
def _(spark, sf):
    return st.reduce_rows(g.ps2(spark, sf), MONOID["plus"])


@query("reduce_column", "ps", "SELECT j AS i, CAST(sum(v) AS BIGINT) AS v FROM ps GROUP BY j")
def _(spark, sf):
    return st.reduce_rows(g.ps(spark, sf), MONOID["plus"], dense=False, desc=Descriptor(tran0=True))


@query("reduce_row_masked", "ps pm", "SELECT i, CAST(sum(v) AS BIGINT) AS v FROM ps WHERE i IN (SELECT i FROM pm WHERE v <> 0) GROUP BY i")
def _(spark, sf):
    return st.reduce_rows(g.ps(spark, sf), MONOID["plus"], mask=g.pm(spark, sf))


# Structure

@query("assign_const_masked", "pv pm", "SELECT a.i, CASE WHEN b.v <> 0 THEN 77 ELSE a.v END AS v FROM pv a LEFT JOIN pm b USING (i)")
def _(spark, sf):
    return st.assign_constant(g.pv(spark, sf), 77, mask=g.pm(spark, sf))


@query("assign_const_complement", "pv pm", "SELECT a.i, CASE WHEN coalesce(b.v, 0) <> 0 THEN a.v ELSE 77 END AS v FROM pv a LEFT JOIN pm b USING (i)")
def _(spark, sf):
    return st.assign_constant(g.pv(spark, sf), 77, mask=g.pm(spark, sf), desc=COMPLEMENT)


def _shift(spark, sf) -> Vector:
    """The suppliers' places moved by one: index k names k + 1."""
    s = g.sv(spark, sf)
    return Vector(s.df.select("i", (F.col("i") + 1).alias("v")), s.size)


@query("assign_vec_indexed", "sv", "SELECT i, coalesce(lag(v) OVER (ORDER BY i), v) AS v FROM sv")
def _(spark, sf):
    return st.assign_indexed(g.sv(spark, sf), g.sv(spark, sf), _shift(spark, sf))


@query("assign_matrix", "nat", "SELECT i, j, v FROM nat WHERE NOT (i BETWEEN 1 AND 3 AND j BETWEEN 2 AND 4) UNION ALL SELECT i + 1, j + 2, v * 1000 FROM nat WHERE i < 3 AND j < 3")
def _(spark, sf):
    a = g.nat(spark, sf)
    return st.assign_matrix(a, ew.scale(a.resize(3, 3), 1000), Vector.build(spark, [0, 1, 2], [1, 2, 3], 3), Vector.build(spark, [0, 1, 2], [2, 3, 4], 3))


@query("assign_column", "nat", "SELECT i, j, v FROM nat WHERE j <> 5 UNION ALL SELECT n_nationkey::BIGINT, 5, n_nationkey::BIGINT FROM nation")
def _(spark, sf):
    a = g.nat(spark, sf)
    return st.assign_column(a, Vector.ascending(spark, a.nrows), 5)


@query("assign_row", "nat", "SELECT i, j, v FROM nat WHERE i <> 5 UNION ALL SELECT 5, n_nationkey::BIGINT, n_nationkey::BIGINT FROM nation")
def _(spark, sf):
    a = g.nat(spark, sf)
    return st.assign_row(a, Vector.ascending(spark, a.ncols), 5)


@query("assign_matrix_constant", "ps ps2", "SELECT i, j, CASE WHEN b.v IS NULL THEN a.v ELSE 1 END AS v FROM ps a LEFT JOIN ps2 b USING (i, j)")
def _(spark, sf):
    return st.assign_matrix_constant(g.ps(spark, sf), 1, g.ps2(spark, sf))


@query("extract_sub", "pv sv", "SELECT s.i, p.v FROM sv s JOIN pv p ON p.i = s.v")
def _(spark, sf):
    return st.extract(g.pv(spark, sf), g.sv(spark, sf))


@query("extract_matrix", "nat", "SELECT i - 3 AS i, j - 4 AS j, v FROM nat WHERE i BETWEEN 3 AND 5 AND j BETWEEN 4 AND 7")
def _(spark, sf):
    return st.extract_matrix(g.nat(spark, sf), Vector.build(spark, [0, 1, 2], [3, 4, 5], 3), Vector.build(spark, [0, 1, 2, 3], [4, 5, 6, 7], 4))


@query("extract_column", "ps", "SELECT i, v FROM ps WHERE j = 2")
def _(spark, sf):
    return st.extract_column(g.ps(spark, sf), None, 2)


@query("scatter_const", "pv sv", "SELECT i, CASE WHEN i > 0 AND i IN (SELECT v FROM sv) THEN 500 ELSE v END AS v FROM pv")
def _(spark, sf):
    return st.scatter(g.pv(spark, sf), g.sv(spark, sf), 500)


@query("assign_scatter", "pv sv", "SELECT p.i, coalesce(m.v, p.v) AS v FROM pv p LEFT JOIN (SELECT v AS i, min(i) AS v FROM sv GROUP BY v) m ON m.i = p.i")
def _(spark, sf):
    s = g.sv(spark, sf)
    return st.assign_scatter(g.pv(spark, sf), Vector.ascending(spark, s.size), s)


@query("extract_gather", "pv pm", "SELECT m.i, p.v FROM pm m JOIN pv p ON p.i = m.v")
def _(spark, sf):
    return st.extract_gather(g.pv(spark, sf), g.pm(spark, sf))


@query("apply_unary_vec", "pv", "SELECT i, v * v + 1 AS v FROM pv")
def _(spark, sf):
    return ew.apply(UnaryOp("square_plus_one", lambda c: c * c + 1), g.pv(spark, sf))


@query("apply_unary_mat", "ps", "SELECT i, j, -v AS v FROM ps")
def _(spark, sf):
    return ew.apply(UnaryOp("negate", lambda c: -c), g.ps(spark, sf))


@query("scale_vec", "pv", "SELECT i, v * 5 AS v FROM pv")
def _(spark, sf):
    return ew.scale(g.pv(spark, sf), 5)


@query("scale_mat", "ps", "SELECT i, j, v * 5 AS v FROM ps")
def _(spark, sf):
    return ew.scale(g.ps(spark, sf), 5)


@query("transpose", "ps", "SELECT j AS i, i AS j, v FROM ps")
def _(spark, sf):
    return st.transpose(g.ps(spark, sf))


@query("tril", "nat", "SELECT * FROM nat WHERE i >= j")
def _(spark, sf):
    return st.tril(g.nat(spark, sf))


@query("triu", "nat", "SELECT * FROM nat WHERE i <= j")
def _(spark, sf):
    return st.triu(g.nat(spark, sf))


# Algorithms

_N = "n AS (SELECT 2 * greatest((SELECT max(p_partkey) FROM part), (SELECT max(s_suppkey) FROM supplier)) + 3 AS n)"
_REACH = "s AS (SELECT min(i) AS s FROM hi), r(v, d) AS (SELECT s, 1 FROM s UNION SELECT hi.j, r.d + 1 FROM r JOIN hi ON hi.i = r.v WHERE r.d < 60)"


@query("bfs", "hi", f"{_N}, {_REACH}, m AS (SELECT v, min(d) AS d FROM r GROUP BY v) SELECT range AS i, coalesce(d, 0)::BIGINT AS v FROM range((SELECT n FROM n)) LEFT JOIN m ON v = range", recursive=True)
def _(spark, sf):
    a = g.hi(spark, sf)
    return alg.bfs(a, g.first_vertex(a))


def _sssp_sql(rounds: int = 60) -> str:
    parts = [_W, "d0 AS MATERIALIZED (SELECT min(i) AS i, 0::BIGINT AS v FROM hi)"]
    parts += [f"d{k} AS MATERIALIZED (SELECT i, min(v) AS v FROM (SELECT * FROM d{k - 1} UNION ALL SELECT w.j, d.v + w.v FROM d{k - 1} d JOIN w ON w.i = d.i) GROUP BY i)" for k in range(1, rounds + 1)]
    return f"{', '.join(parts)} SELECT * FROM d{rounds}"


@query("sssp", "hi", _sssp_sql())
def _(spark, sf):
    a = g.hi(spark, sf, weighted=True)
    return alg.sssp(a, g.first_vertex(a), dense=False)


@query("diameter", "hi", "s AS (SELECT min(i) AS s FROM hi), r(src, v, d) AS (SELECT range, range, 0 FROM range((SELECT s FROM s), (SELECT s + 6 FROM s)) UNION SELECT r.src, hi.j, r.d + 1 FROM r JOIN hi ON hi.i = r.v WHERE r.d < 60), m AS (SELECT src, v, min(d) AS d FROM r GROUP BY 1, 2), e AS (SELECT src, max(d) AS ecc FROM m GROUP BY src) SELECT ecc::BIGINT AS ecc, max(src) AS src FROM e WHERE ecc = (SELECT max(ecc) FROM e) GROUP BY ecc", recursive=True)
def _(spark, sf):
    a = g.hi(spark, sf)
    s = g.first_vertex(a)
    return alg.diameter_df(a, s, s + 6)


@query("cc", "hi", f"{_N}, c(root, v) AS (SELECT DISTINCT i, i FROM hi UNION SELECT c.root, hi.j FROM c JOIN hi ON hi.i = c.v), m AS (SELECT v, min(root) AS l FROM c GROUP BY v) SELECT range AS i, coalesce(l, range) AS v FROM range((SELECT n FROM n)) LEFT JOIN m ON v = range", recursive=True)
def _(spark, sf):
    return alg.connected_components(g.hi(spark, sf))


def _pagerank_sql(rounds: int = 10) -> str:
    parts = ["n AS (SELECT max(user_id) + 1 AS n FROM events)", "e AS (SELECT i, j, 0.85::DOUBLE / count(*) OVER (PARTITION BY i) AS w FROM users)", "p0 AS MATERIALIZED (SELECT range AS i, 1.0::DOUBLE / n AS v FROM n, range((SELECT n FROM n)))"]
    parts += [f"p{k} AS MATERIALIZED (SELECT p.i, coalesce(g.v, 0) + (1 - 0.85::DOUBLE) / n AS v FROM n, p{k - 1} p LEFT JOIN (SELECT e.j AS i, sum(q.v * e.w) AS v FROM p{k - 1} q JOIN e ON e.i = q.i GROUP BY 1) g ON g.i = p.i)" for k in range(1, rounds + 1)]
    return f"{', '.join(parts)} SELECT i, round(v, 8) AS v FROM p{rounds}"


@query("pagerank_10", "users", _pagerank_sql())
def _(spark, sf):
    return alg.pagerank(g.users(spark, sf), eps=0.0, max_rounds=10).df.withColumn("v", F.round("v", 8))


_SYM = "u AS (SELECT i, j FROM users UNION SELECT j, i FROM users)"


@query("triangle_count", "users", f"{_SYM} SELECT count(*) AS v FROM u a JOIN u b ON a.i = b.i AND a.i > a.j AND a.j > b.j JOIN u c ON c.i = a.j AND c.j = b.j")
def _(spark, sf):
    return alg.triangle_count_df(alg.symmetric(g.users(spark, sf)))


def _lgc_sql(rounds: int = 5, alpha: float = 0.15, eps: float = 1e-4) -> str:
    parts = [_SYM, "dg AS (SELECT i, count(*) AS deg FROM u GROUP BY i)", "s0 AS MATERIALIZED (SELECT min(i) AS i, 0.0::DOUBLE AS p, 1.0::DOUBLE AS r FROM users)"]
    for k in range(1, rounds + 1):
        on = "deg IS NOT NULL" if k == 1 else f"(deg IS NOT NULL AND r >= deg * {eps!r}::DOUBLE)"
        parts += [
            f"a{k} AS MATERIALIZED (SELECT s.*, deg, {on} AS act FROM s{k - 1} s LEFT JOIN dg USING (i))",
            f"h{k} AS (SELECT u.j AS i, sum({(1 - alpha) / 2!r}::DOUBLE * r / deg) AS got FROM a{k} a JOIN u ON u.i = a.i WHERE act GROUP BY 1)",
            f"s{k} AS MATERIALIZED (SELECT coalesce(a.i, h.i) AS i, coalesce(CASE WHEN act THEN p + {alpha!r}::DOUBLE * r ELSE p END, 0) AS p, coalesce(CASE WHEN act THEN {(1 - alpha) / 2!r}::DOUBLE * r ELSE r END, 0) + coalesce(got, 0) AS r FROM a{k} a FULL JOIN h{k} h ON a.i = h.i)",
        ]
    return f"{', '.join(parts)} SELECT i, round(p, 8) AS v FROM s{rounds} WHERE p > 0"


@query("lgc_k", "users", _lgc_sql())
def _(spark, sf):
    a = g.users(spark, sf)
    return alg.local_clustering(a, g.first_vertex(a), alpha=0.15, eps=1e-4, rounds=5).df.withColumn("v", F.round("v", 8))


@query("cc_violations", "hi", f"{_N}, c(root, v) AS (SELECT DISTINCT i, i FROM hi UNION SELECT c.root, hi.j FROM c JOIN hi ON hi.i = c.v), m AS (SELECT v, min(root) AS l FROM c GROUP BY v) SELECT 0::BIGINT AS crossing, 0::BIGINT AS mislabelled, CAST((SELECT n FROM n) - (SELECT count(*) FROM m) + (SELECT count(DISTINCT l) FROM m) AS BIGINT) AS labels", recursive=True)
def _(spark, sf):
    a = g.hi(spark, sf)
    return verify.component_violations(a, alg.connected_components(a))


@query("mis_violations", "", "SELECT 0::BIGINT AS adjacent, 0::BIGINT AS uncovered")
def _(spark, sf):
    a = g.hi(spark, sf)
    return verify.independence_violations(a, alg.maximal_independent_set(a))


_COLORINGS = {"gc_jp_violations": alg.color_jones_plassmann, "gc_mis_violations": alg.color_mis, "gc_is_violations": alg.color_independent, "gc_jp_round_violations": lambda a: alg.color_jones_plassmann(a, per_round=True)}
for _name, _fn in _COLORINGS.items():
    _each(_name, "", "SELECT 0::BIGINT AS conflicts, 0::BIGINT AS uncolored", lambda spark, sf, f=_fn: (lambda a: verify.coloring_violations(a, f(a)))(g.hi(spark, sf)))


# Files and streams


@query("matrix_market_round_trip", "nat", "SELECT i, j, v FROM nat")
def _(spark, sf):
    write_mtx(g.nat(spark, sf), path := scratch(spark, "mtx"), "integer")
    return read_mtx(spark, path, keep_loops=True)


@query("matrix_market_undirected", "nat", "SELECT i, j, min(v) AS v FROM (SELECT i, j, v FROM nat UNION ALL SELECT j, i, v FROM nat) WHERE i <> j GROUP BY i, j")
def _(spark, sf):
    write_mtx(g.nat(spark, sf), path := scratch(spark, "mtx"), "integer")
    return read_mtx(spark, path, UNDIRECTED)


@query("parquet_round_trip", "ps", "SELECT i, j, v FROM ps")
def _(spark, sf):
    save(g.ps(spark, sf), path := scratch(spark, "saved"))
    return load(spark, path)


@query("stream_of_edges", "", "SELECT l_partkey AS i, l_suppkey AS j, CAST(sum(l_linenumber) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    arrived, _ = cut(_lines(spark, sf), "arrived")
    stream = spark.readStream.schema(arrived.schema).parquet(arrived.inputFiles()[0].rsplit("/", 1)[0])
    ingest_edges(stream, path := scratch(spark, "edges"), scratch(spark, "stream")).awaitTermination()
    return current(spark, path)
