"""Verifiers: counts of violated rules, 0 for a right answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.objects import Matrix, Vector


def _ends(A: Matrix, x: Vector) -> DataFrame:
    """(i, j, vi, vj) of every edge but self-loops, with the values at its ends."""
    vi, vj = x.df.select("i", F.col("v").alias("vi")), x.df.select(F.col("i").alias("j"), F.col("v").alias("vj"))
    return A.df.where("i <> j").select("i", "j").join(vi, "i").join(vj, "j")


def component_violations(A: Matrix, labels: Vector) -> DataFrame:
    """One row: edges between labels, labels that are not their component's smallest index, number of labels."""
    cross = _ends(A, labels).agg(F.coalesce(F.sum((F.col("vi") != F.col("vj")).cast("long")), F.lit(0)).alias("crossing"))
    own = labels.df.groupBy("v").agg(F.min("i").alias("m")).agg(F.coalesce(F.sum((F.col("m") != F.col("v")).cast("long")), F.lit(0)).alias("mislabelled"), F.count("*").alias("labels"))
    return cross.withColumn("k", F.lit(1)).join(own.withColumn("k", F.lit(1)), "k").drop("k")


def coloring_violations(A: Matrix, colors: Vector) -> DataFrame:
    """One row: edges with one color at both ends, vertices without a color."""
    same = _ends(A, colors).agg(F.coalesce(F.sum((F.col("vi") == F.col("vj")).cast("long")), F.lit(0)).alias("conflicts"))
    none = colors.df.agg((F.lit(A.nrows) - F.coalesce(F.sum((F.col("v") > 0).cast("long")), F.lit(0))).alias("uncolored"))
    return same.withColumn("k", F.lit(1)).join(none.withColumn("k", F.lit(1)), "k").drop("k")


def independence_violations(A: Matrix, chosen: Vector) -> DataFrame:
    """One row: edges inside the set, vertices that could still join it. Directions don't count."""
    ends = _ends(A, chosen)
    inside = ends.agg(F.coalesce(F.sum(((F.col("vi") != 0) & (F.col("vj") != 0)).cast("long")), F.lit(0)).alias("adjacent"))
    beside = ends.where("vi <> 0").select(F.col("j").alias("i")).unionByName(ends.where("vj <> 0").select("i"))
    free = chosen.df.where("v = 0").join(beside, "i", "left_anti").agg(F.count("*").alias("uncovered"))
    return inside.withColumn("k", F.lit(1)).join(free.withColumn("k", F.lit(1)), "k").drop("k")
