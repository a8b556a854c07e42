"""Matrices and vectors over the TPC-H-like tables, each with the SQL that defines it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.operators.objects import Matrix, Vector

#: Bounds of indices at any scale: keys are 0-based and dense.
SQL = {
    "ps": "SELECT l_partkey AS i, l_suppkey AS j, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2",
    "ps2": "SELECT l_partkey AS i, l_suppkey AS j, CAST(count(*) AS BIGINT) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2",
    "nat": "SELECT c.c_nationkey::BIGINT AS i, s.s_nationkey::BIGINT AS j, CAST(count(*) AS BIGINT) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey GROUP BY 1, 2",
    "pv": "SELECT p_partkey AS i, p_size::BIGINT AS v FROM part",
    "pm": "SELECT p_partkey AS i, (p_size % 3)::BIGINT AS v FROM part WHERE p_size % 2 = 0",
    "sv": "SELECT s_suppkey AS i, (s_nationkey + 1)::BIGINT AS v FROM supplier",
    "sm": "SELECT s_suppkey AS i, (s_nationkey % 3)::BIGINT AS v FROM supplier WHERE s_nationkey % 2 = 0",
    "hi": "SELECT DISTINCT i, j FROM (SELECT l_partkey * 2 AS i, l_suppkey * 2 + 1 AS j FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R' UNION ALL SELECT l_suppkey * 2 + 1, l_partkey * 2 FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R')",
    "users": "SELECT DISTINCT i, j FROM (SELECT user_id AS i, lead(user_id) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS j FROM events) WHERE j IS NOT NULL AND i <> j",
}

#: Lines that a task sums up by pair, about.
LINES = 250_000


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _bound(df: DataFrame, *cols: str) -> int:
    """One more than the largest index, from one aggregate that Parquet's statistics can answer."""
    row = df.agg(*(F.max(c) for c in cols)).first()
    return max([1, *(x + 1 for x in row if x is not None)])


def _pairs(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """(i, j, more) of lineitem, dealt by pair to a partition for LINES lines, so that a task sums up no more than about these.

    Nearly every pair is one line, so a sum before the shuffle would hold as many pairs as its part of the file has lines, and save none.
    """
    lines = _table(spark, sf, "lineitem")
    return lines.select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), *more).repartition(max(1, -(-lines.count() // LINES)), "i", "j")


def shape_ps(spark: SparkSession, sf: str) -> tuple[int, int]:
    return _bound(_table(spark, sf, "part"), "p_partkey"), _bound(_table(spark, sf, "supplier"), "s_suppkey")


def ps(spark: SparkSession, sf: str) -> Matrix:
    """Part x supplier, sums of quantities."""
    df = _pairs(spark, sf, "l_quantity").groupBy("i", "j").agg(F.sum("l_quantity").cast("long").alias("v"))
    return Matrix(df, *shape_ps(spark, sf))


def ps2(spark: SparkSession, sf: str) -> Matrix:
    """Part x supplier, counts of returned lines."""
    df = _pairs(spark, sf, "l_returnflag").where("l_returnflag = 'R'").groupBy("i", "j").agg(F.count("*").alias("v"))
    return Matrix(df, *shape_ps(spark, sf))


def nat(spark: SparkSession, sf: str) -> Matrix:
    """Customer's nation x supplier's nation, counts of lines."""
    c, s = _table(spark, sf, "customer").select("c_custkey", "c_nationkey"), _table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    o = _table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    x = _table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    n = _bound(_table(spark, sf, "nation"), "n_nationkey")
    return Matrix(x.groupBy(F.col("c_nationkey").cast("long").alias("i"), F.col("s_nationkey").cast("long").alias("j")).agg(F.count("*").alias("v")), n, n)


def pv(spark: SparkSession, sf: str) -> Vector:
    p = _table(spark, sf, "part")
    return Vector(p.select(F.col("p_partkey").alias("i"), F.col("p_size").cast("long").alias("v")), _bound(p, "p_partkey"), True)


def pm(spark: SparkSession, sf: str) -> Vector:
    """A mask over parts, with stored zeros."""
    p = _table(spark, sf, "part")
    return Vector(p.where("p_size % 2 = 0").select(F.col("p_partkey").alias("i"), (F.col("p_size") % 3).cast("long").alias("v")), _bound(p, "p_partkey"))


def sv(spark: SparkSession, sf: str) -> Vector:
    s = _table(spark, sf, "supplier")
    return Vector(s.select(F.col("s_suppkey").alias("i"), (F.col("s_nationkey") + 1).cast("long").alias("v")), _bound(s, "s_suppkey"), True)


def sm(spark: SparkSession, sf: str) -> Vector:
    s = _table(spark, sf, "supplier")
    return Vector(s.where("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("i"), (F.col("s_nationkey") % 3).cast("long").alias("v")), _bound(s, "s_suppkey"))


def hi(spark: SparkSession, sf: str, weighted: bool = False) -> Matrix:
    """Undirected part-supplier graph of large returned lines; parts are even, suppliers odd. Weights are 1 + (31 i + 17 j) mod 64."""
    x = _table(spark, sf, "lineitem").where("l_quantity >= 49 AND l_returnflag = 'R'").select((F.col("l_partkey") * 2).alias("i"), (F.col("l_suppkey") * 2 + 1).alias("j")).distinct()
    both = x.unionByName(x.select(F.col("j").alias("i"), F.col("i").alias("j")))
    v = 1 + F.pmod(31 * F.col("i") + 17 * F.col("j"), F.lit(64)) if weighted else F.lit(1)
    n, m = shape_ps(spark, sf)
    size = 2 * max(n, m) + 1
    return Matrix(both.withColumn("v", v.cast("long")), size, size)


def users(spark: SparkSession, sf: str) -> Matrix:
    """From each user to the one whose event comes next on the same day; days are windows of their own."""
    w = Window.partitionBy(F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    e = _table(spark, sf, "events")
    x = e.select(F.col("user_id").alias("i"), F.lead("user_id").over(w).alias("j")).where("j IS NOT NULL AND i <> j").distinct()
    n = _bound(e, "user_id")
    return Matrix(x.withColumn("v", F.lit(1).cast("long")), n, n)


def first_vertex(A: Matrix) -> int:
    return A.df.agg(F.min("i")).first()[0] or 0
