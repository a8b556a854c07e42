"""Vectors, matrices and descriptors.

A vector is a DataFrame (i, v) with a size, a matrix a DataFrame (i, j, v) with a shape. Objects never change: every
method returns a new one, lazily. An entry that is not stored means the identity of the operator at hand;
v is never null. "Dense" says that every index has an entry.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.errors import DimensionMismatch, DomainMismatch, IndexOutOfBounds, InsufficientSpace, InvalidObject, InvalidValue, NoValue
from lattica.functions.algebra import BINARY, BinaryOp, Monoid, MONOID

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


@dataclass(frozen=True)
class Descriptor:
    """How a call reads its arguments: complement of the mask, replacement of what the mask leaves out, transposes, and a hint for products.

    mode: auto leaves the join to Spark, push broadcasts the vector if it is small, pull never does.
    """

    complement: bool = False
    replace: bool = False
    tran0: bool = False
    tran1: bool = False
    mode: str = "auto"

    def toggle(self, field: str) -> Descriptor:
        if field not in ("complement", "replace", "tran0", "tran1"):
            raise InvalidValue(f"{field} can't be toggled")
        return replace(self, **{field: not getattr(self, field)})


DEFAULT = Descriptor()


def _same(what: str, a: int, b: int) -> None:
    if a != b:
        raise DimensionMismatch(f"{what}: {a} and {b}")


def _typed(df: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    kinds = dict(df.dtypes)
    if kinds.get("v") not in _NUMERIC:
        raise DomainMismatch(f"values of type {kinds.get('v')}")
    v = F.col("v").cast("long") if kinds["v"] in ("tinyint", "smallint", "int", "boolean") else F.col("v").cast("double") if kinds["v"] == "float" else F.col("v")
    return df.select(*(F.col(c).cast("long").alias(c) for c in cols), v.alias("v"))


def combine(df: DataFrame, keys: tuple[str, ...], dup: Monoid | BinaryOp | None) -> DataFrame:
    """One entry per index: duplicates meet in dup, a monoid, or first and second by value."""
    if dup is None:
        return df
    if isinstance(dup, BinaryOp):
        named = {"plus": "plus", "multiplies": "multiplies", "minimum": "minimum", "maximum": "maximum", "logical_or": "logical_or", "logical_and": "logical_and"}
        if dup.name in ("first", "second"):
            return df.groupBy(*keys).agg((F.min if dup.name == "first" else F.max)("v").alias("v"))
        if dup.name not in named:
            raise InvalidValue(f"{dup.name} can't combine duplicates")
        dup = MONOID[named[dup.name]]
    return dup.over(df, keys, F.col("v"))


@dataclass(frozen=True)
class Vector:
    df: DataFrame
    size: int
    dense: bool = False

    @staticmethod
    def new(spark: SparkSession, size: int, dtype: str = "double") -> Vector:
        return Vector(spark.createDataFrame([], f"i long, v {dtype}"), size)

    @staticmethod
    def of(df: DataFrame, size: int, dup: Monoid | BinaryOp | None = None) -> Vector:
        """Wrap a DataFrame (i, v); with dup, indices may repeat."""
        return Vector(combine(_typed(df, ("i",)), ("i",), dup), size)

    @staticmethod
    def build(spark: SparkSession, indices: Sequence[int], values: Sequence, size: int, dup: Monoid | BinaryOp = BINARY["plus"]) -> Vector:
        if len(indices) != len(values):
            raise DimensionMismatch("as many values as indices")
        if any(not 0 <= i < size for i in indices):
            raise IndexOutOfBounds(f"an index is not below {size}")
        kind = "double" if any(isinstance(v, float) for v in values) else "long"
        rows = [(int(i), float(v) if kind == "double" else int(v)) for i, v in zip(indices, values, strict=True)]
        return Vector.of(spark.createDataFrame(rows, f"i long, v {kind}"), size, dup)

    @staticmethod
    def build_dense(spark: SparkSession, values: Sequence) -> Vector:
        return replace(Vector.build(spark, range(len(values)), values, len(values)), dense=True)

    @staticmethod
    def fill(spark: SparkSession, size: int, value) -> Vector:
        return Vector(spark.range(size).select(F.col("id").alias("i"), F.lit(value).cast("double" if isinstance(value, float) else "long").alias("v")), size, True)

    @staticmethod
    def ascending(spark: SparkSession, size: int) -> Vector:
        return Vector(spark.range(size).select(F.col("id").alias("i"), F.col("id").alias("v")), size, True)

    def dup(self) -> Vector:
        return self

    def clear(self) -> Vector:
        return Vector(self.df.limit(0), self.size)

    def nvals(self) -> int:
        return self.size if self.dense else self.df.count()

    def nnz(self, identity=0) -> int:
        return self.df.where(F.col("v") != identity).count()

    def set_element(self, index: int, value) -> Vector:
        if not 0 <= index < self.size:
            raise IndexOutOfBounds(f"{index} is not below {self.size}")
        one = self.df.sparkSession.range(1).select(F.lit(index).cast("long").alias("i"), F.lit(value).cast(dict(self.df.dtypes)["v"]).alias("v"))
        return replace(self, df=self.df.where(F.col("i") != index).unionByName(one))

    def extract_element(self, index: int):
        row = self.df.where(F.col("i") == index).select("v").first()
        if row is None:
            raise NoValue(index)
        return row[0]

    def extract_tuples(self, limit: int | None = None) -> list[tuple]:
        """Entries by index, on the driver; more than limit is an error."""
        rows = self.df.orderBy("i").collect() if limit is None else self.df.orderBy("i").take(limit + 1)
        if limit is not None and len(rows) > limit:
            raise InsufficientSpace(f"more than {limit} entries")
        return [(r["i"], r["v"]) for r in rows]

    def resize(self, size: int) -> Vector:
        return Vector(self.df.where(F.col("i") < size), size, self.dense and size <= self.size)

    def count_unique(self) -> int:
        return self.df.agg(F.count_distinct("v")).first()[0]

    def to_dense(self, identity=0) -> Vector:
        kind = dict(self.df.dtypes)["v"]
        every = self.df.sparkSession.range(self.size).withColumnRenamed("id", "i")
        return Vector(every.join(self.df, "i", "left").select("i", F.coalesce("v", F.lit(identity).cast(kind)).alias("v")), self.size, True)

    def to_sparse(self, identity=0) -> Vector:
        return Vector(self.df.where(F.col("v") != identity), self.size)

    def true_indices(self) -> DataFrame:
        """(i) where the vector as a mask is true: stored and not 0."""
        return self.df.where(F.col("v") != 0).select("i")

    def show(self, n: int = 40) -> None:
        self.df.orderBy("i").show(n)

    def check(self) -> None:
        """Indices within the size, none twice, no null; runs a job."""
        bad = self.df.groupBy("i").agg(F.count("*").alias("n"), F.count("v").alias("m")).where(F.col("i").isNull() | (F.col("i") < 0) | (F.col("i") >= self.size) | (F.col("n") > 1) | (F.col("m") < 1))
        if bad.limit(1).count():
            raise InvalidObject("indices out of range or repeated, or null values")


@dataclass(frozen=True)
class Matrix:
    df: DataFrame
    nrows: int
    ncols: int

    def __post_init__(self):
        if self.nrows <= 0 or self.ncols <= 0:
            raise InvalidValue("a matrix has at least one row and column")

    @staticmethod
    def new(spark: SparkSession, nrows: int, ncols: int, dtype: str = "double") -> Matrix:
        return Matrix(spark.createDataFrame([], f"i long, j long, v {dtype}"), nrows, ncols)

    @staticmethod
    def of(df: DataFrame, nrows: int, ncols: int, dup: Monoid | BinaryOp | None = None) -> Matrix:
        return Matrix(combine(_typed(df, ("i", "j")), ("i", "j"), dup), nrows, ncols)

    @staticmethod
    def build(spark: SparkSession, rows: Sequence[int], cols: Sequence[int], values: Sequence, nrows: int, ncols: int, dup: Monoid | BinaryOp = BINARY["plus"]) -> Matrix:
        if not len(rows) == len(cols) == len(values):
            raise DimensionMismatch("as many rows as columns and values")
        if any(not 0 <= i < nrows for i in rows) or any(not 0 <= j < ncols for j in cols):
            raise IndexOutOfBounds("an index is outside the shape")
        kind = "double" if any(isinstance(v, float) for v in values) else "long"
        data = [(int(i), int(j), float(v) if kind == "double" else int(v)) for i, j, v in zip(rows, cols, values, strict=True)]
        return Matrix.of(spark.createDataFrame(data, f"i long, j long, v {kind}"), nrows, ncols, dup)

    @staticmethod
    def build_csr(spark: SparkSession, rowptr: Sequence[int], colind: Sequence[int], values: Sequence, ncols: int) -> Matrix:
        rows = [r for r in range(len(rowptr) - 1) for _ in range(rowptr[r + 1] - rowptr[r])]
        return Matrix.build(spark, rows, colind, values, len(rowptr) - 1, ncols)

    @staticmethod
    def build_dense(spark: SparkSession, values: Sequence[Sequence]) -> Matrix:
        """Row by row, every entry stored."""
        n, m = len(values), len(values[0]) if values else 0
        return Matrix.build(spark, [r for r in range(n) for _ in range(m)], [*range(m)] * n, [x for row in values for x in row], n, m)

    def dup(self) -> Matrix:
        return self

    def clear(self) -> Matrix:
        return replace(self, df=self.df.limit(0))

    def nvals(self) -> int:
        return self.df.count()

    def set_element(self, row: int, col: int, value) -> Matrix:
        if not (0 <= row < self.nrows and 0 <= col < self.ncols):
            raise IndexOutOfBounds((row, col))
        one = self.df.sparkSession.range(1).select(F.lit(row).cast("long").alias("i"), F.lit(col).cast("long").alias("j"), F.lit(value).cast(dict(self.df.dtypes)["v"]).alias("v"))
        return replace(self, df=self.df.where((F.col("i") != row) | (F.col("j") != col)).unionByName(one))

    def extract_element(self, row: int, col: int):
        found = self.df.where((F.col("i") == row) & (F.col("j") == col)).select("v").first()
        if found is None:
            raise NoValue((row, col))
        return found[0]

    def extract_tuples(self, limit: int | None = None) -> list[tuple]:
        rows = self.df.orderBy("i", "j").collect() if limit is None else self.df.orderBy("i", "j").take(limit + 1)
        if limit is not None and len(rows) > limit:
            raise InsufficientSpace(f"more than {limit} entries")
        return [(r["i"], r["j"], r["v"]) for r in rows]

    def resize(self, nrows: int, ncols: int) -> Matrix:
        return Matrix(self.df.where((F.col("i") < nrows) & (F.col("j") < ncols)), nrows, ncols)

    def fill(self, value) -> Matrix:
        """The same pattern with one value."""
        return replace(self, df=self.df.withColumn("v", F.lit(value).cast("double" if isinstance(value, float) else "long")))

    @property
    def T(self) -> Matrix:
        return Matrix(self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), self.ncols, self.nrows)

    def true_indices(self) -> DataFrame:
        return self.df.where(F.col("v") != 0).select("i", "j")

    def show(self, n: int = 40) -> None:
        self.df.orderBy("i", "j").show(n)

    def check(self) -> None:
        """Indices within the shape, none twice, no null; runs a job."""
        outside: Column = (F.col("i") < 0) | (F.col("i") >= self.nrows) | (F.col("j") < 0) | (F.col("j") >= self.ncols)
        bad = self.df.groupBy("i", "j").agg(F.count("*").alias("n"), F.count("v").alias("m")).where(F.col("i").isNull() | F.col("j").isNull() | outside | (F.col("n") > 1) | (F.col("m") < 1))
        if bad.limit(1).count():
            raise InvalidObject("indices out of range or repeated, or null values")
