"""Matrix Market files and Parquet tables as matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.errors import DomainMismatch, InvalidValue
from lattica.operators.objects import Matrix, Vector

DIRECTED, UNDIRECTED, AS_STORED = 1, 2, 0


def _header(spark: SparkSession, path: str) -> tuple[list[str], tuple[int, int, int], str]:
    """The banner's words, the size line and the file that has them; path may be a folder of parts, in any order."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    banner = lines.where(F.col("value").startswith("%%MatrixMarket")).first()
    if banner is None:
        raise InvalidValue(f"{path} has no Matrix Market banner")
    size = lines.where((F.col("file") == banner["file"]) & ~F.col("value").startswith("%") & (F.trim("value") != "")).first()
    if size is None:
        raise InvalidValue(f"{path} has no size line")
    return banner[0].lower().split(), tuple(int(x) for x in size[0].split()[:3]), banner["file"]


def read_mtx(spark: SparkSession, path: str, direction: int = AS_STORED, keep_loops: bool = False, weighted: bool = True) -> Matrix:
    """Read a coordinate file with pattern, integer or real values; indices become 0-based.

    direction: as stored (a symmetric file gives both directions), directed, or undirected (both
    directions always). Of repeated entries the one that comes first by value
    stays, with its own value. Self-loops are dropped unless kept. Patterns, and all
    files unless weighted, have value 1. The file is split among tasks like any text.
    """
    banner, (nrows, ncols, _), first = _header(spark, path)
    if banner[1:3] != ["matrix", "coordinate"]:
        raise InvalidValue("only coordinate matrices are read")
    kind, shape = banner[3], banner[4]
    if kind not in ("pattern", "integer", "real"):
        raise DomainMismatch(f"values of kind {kind}")
    if shape not in ("general", "symmetric"):
        raise InvalidValue(f"symmetry {shape}")
    x = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    x = x.withColumn("f", F.split(F.trim("value"), r"\s+"))
    entry = F.size("f") >= (2 if kind == "pattern" else 3)
    v = F.lit(1).cast("long") if kind == "pattern" or not weighted else F.get("f", F.lit(2)).cast("long" if kind == "integer" else "double")
    # the size line is known by its place, not its looks: it is the first line of its file that is no comment
    x = x.withColumn("place", F.monotonically_increasing_id())
    size_place = x.where(F.col("file") == first).agg(F.min("place")).first()[0]
    df = x.where(entry & (F.col("place") != size_place)).select((F.get("f", F.lit(0)).cast("long") - 1).alias("i"), (F.get("f", F.lit(1)).cast("long") - 1).alias("j"), v.alias("v"))
    if direction == UNDIRECTED or (direction == AS_STORED and shape == "symmetric"):
        df = df.unionByName(df.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    if not keep_loops:
        df = df.where("i <> j")
    return Matrix(df.groupBy("i", "j").agg(F.min("v").alias("v")), nrows, ncols)


def write_mtx(A: Matrix, path: str, kind: str = "real") -> None:
    """Write a general coordinate matrix as a folder of text; the header is in its first part, entries ascend."""
    body = A.df.orderBy("i", "j").select(F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), *([] if kind == "pattern" else [F.col("v").cast("string")])).alias("value"), F.col("i"), F.col("j"))
    head = A.df.sparkSession.createDataFrame([(f"%%MatrixMarket matrix coordinate {kind} general", -2, 0), (f"{A.nrows} {A.ncols} {A.nvals()}", -1, 0)], "value string, i long, j long")
    head.unionByName(body).repartitionByRange(F.col("i"), F.col("j")).sortWithinPartitions("i", "j").select("value").write.text(path)


def save(x: Matrix | Vector, path: str) -> None:
    """Parquet with values; the shape is kept beside them."""
    spark = x.df.sparkSession
    shape = (x.nrows, x.ncols) if isinstance(x, Matrix) else (x.size, -1)
    x.df.write.parquet(f"{path}/entries")
    spark.createDataFrame([shape], "n long, m long").coalesce(1).write.parquet(f"{path}/shape")


def load(spark: SparkSession, path: str) -> Matrix | Vector:
    n, m = spark.read.parquet(f"{path}/shape").first()
    df: DataFrame = spark.read.parquet(f"{path}/entries")
    return Matrix(df, n, m) if m >= 0 else Vector(df, n)
