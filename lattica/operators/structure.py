"""Reductions, and operators that move, set or take entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.errors import IndexOutOfBounds
from lattica.functions.algebra import BinaryOp, Monoid
from lattica.operators.objects import DEFAULT, Descriptor, Matrix, Vector, _same
from lattica.operators.output import masked, write
from lattica.operators.products import _given


def reduce_rows(A: Matrix, monoid: Monoid, mask: Vector | None = None, accum: BinaryOp | None = None, w: Vector | None = None, desc: Descriptor = DEFAULT, dense: bool = True) -> Vector:
    """For each row the monoid over its entries; dense: rows without entries get the identity. tran0 reduces columns."""
    _given(A)
    a = A.T if desc.tran0 else A
    t = monoid.over(masked(a.df, mask, ("i",), desc), ("i",), F.col("v"))
    out = Vector(write(t, ("i",), w.df if w else None, mask, accum, desc), a.nrows)
    return out.to_dense(monoid.identity_of(dict(out.df.dtypes)["v"])) if dense and mask is None and accum is None else out


def reduce_df(x: Vector | Matrix, monoid: Monoid) -> DataFrame:
    """One row with the monoid over all entries, its identity if there are none."""
    _given(x)
    return monoid.over(x.df, (), F.col("v"))


def reduce_scalar(x: Vector | Matrix, monoid: Monoid, accum: BinaryOp | None = None, value=None):
    df = reduce_df(x, monoid)
    return df.select(accum(F.lit(value), F.col("v"))).first()[0] if accum else df.first()[0]


def transpose(A: Matrix, mask: Matrix | None = None, accum: BinaryOp | None = None, C: Matrix | None = None, desc: Descriptor = DEFAULT) -> Matrix:
    t = A.T if not desc.tran0 else A
    return Matrix(write(masked(t.df, mask, ("i", "j"), desc), ("i", "j"), C.df if C else None, mask, accum, desc), t.nrows, t.ncols)


def tril(A: Matrix) -> Matrix:
    """Entries on and below the diagonal."""
    return Matrix(A.df.where("i >= j"), A.nrows, A.ncols)


def triu(A: Matrix) -> Matrix:
    """Entries on and above the diagonal."""
    return Matrix(A.df.where("i <= j"), A.nrows, A.ncols)


def index_list(u: Vector) -> DataFrame:
    """(k, x): the entries of a vector as a list of indices; positions keep their place."""
    return u.df.select(F.col("i").alias("k"), F.col("v").cast("long").alias("x"))


def extract(u: Vector, indices: Vector, mask: Vector | None = None, accum: BinaryOp | None = None, w: Vector | None = None, desc: Descriptor = DEFAULT) -> Vector:
    """w(k) = u(indices(k)); positions whose index is not stored in u, or is outside it, have no entry."""
    _given(u, indices)
    t = index_list(indices).join(u.df, F.col("x") == F.col("i")).select(F.col("k").alias("i"), "v")
    t = masked(t, mask, ("i",), desc)
    return Vector(write(t, ("i",), w.df if w else None, mask, accum, desc), indices.size)


extract_gather = extract


def extract_matrix(A: Matrix, rows: Vector | None, cols: Vector | None, mask: Matrix | None = None, desc: Descriptor = DEFAULT) -> Matrix:
    """C(k,l) = A(rows(k), cols(l)); None takes all."""
    df, n, m = A.df, A.nrows, A.ncols
    if rows is not None:
        df, n = index_list(rows).join(df, F.col("x") == F.col("i")).select(F.col("k").alias("i"), "j", "v"), rows.size
    if cols is not None:
        df, m = index_list(cols).join(df, F.col("x") == F.col("j")).select("i", F.col("k").alias("j"), "v"), cols.size
    return Matrix(masked(df, mask, ("i", "j"), desc), n, m)


def extract_column(A: Matrix, rows: Vector | None, col: int, desc: Descriptor = DEFAULT) -> Vector:
    """w(k) = A(rows(k), col); tran0 takes a row."""
    a = A.T if desc.tran0 else A
    if not 0 <= col < a.ncols:
        raise IndexOutOfBounds(col)
    column = Vector(a.df.where(F.col("j") == col).select("i", "v"), a.nrows)
    return column if rows is None else extract(column, rows)


def assign_constant(w: Vector, value, mask: Vector | None = None, indices: Vector | None = None, accum: BinaryOp | None = None, desc: Descriptor = DEFAULT) -> Vector:
    """w<mask>(indices) = value, everywhere that the mask and the indices allow."""
    kind = dict(w.df.dtypes)["v"]
    every = w.df.sparkSession.range(w.size).select(F.col("id").alias("i")) if indices is None else index_list(indices).select(F.col("x").alias("i")).where((F.col("i") >= 0) & (F.col("i") < w.size)).distinct()
    if indices is None and mask is not None and not desc.complement:
        every = mask.true_indices()  # no need to list every index
    else:
        every = masked(every, mask, ("i",), desc)
    return _put(w, every.select("i", F.lit(value).cast(kind).alias("v")), accum, mask, desc)


def _put(w, new: DataFrame, accum: BinaryOp | None, mask=None, desc: Descriptor = DEFAULT):
    keys = ("i", "j") if isinstance(w, Matrix) else ("i",)
    old = masked(w.df, mask, keys, desc) if desc.replace else w.df
    if accum is None:
        df = old.join(new, list(keys), "left_anti").unionByName(new)
    else:
        df = write(new, keys, old, None, accum, DEFAULT)
    return Matrix(df, w.nrows, w.ncols) if isinstance(w, Matrix) else Vector(df, w.size)


def assign_indexed(w: Vector, u: Vector, indices: Vector, accum: BinaryOp | None = None) -> Vector:
    """w(indices(k)) = u(k). Where several k name one index the least value stands; indices outside w are skipped."""
    new = index_list(indices).where((F.col("x") >= 0) & (F.col("x") < w.size)).join(u.df, F.col("k") == F.col("i"))
    return _put(w, new.groupBy(F.col("x").alias("i")).agg(F.min("v").alias("v")), accum)


assign_scatter = assign_indexed


def assign_matrix(C: Matrix, A: Matrix, rows: Vector, cols: Vector, accum: BinaryOp | None = None) -> Matrix:
    """C(rows(k), cols(l)) = A(k,l): entries of that region which A lacks go."""
    _same("rows", A.nrows, rows.size)
    _same("columns", A.ncols, cols.size)
    r, c = index_list(rows).select(F.col("k").alias("i"), F.col("x").alias("_r")), index_list(cols).select(F.col("k").alias("j"), F.col("x").alias("_c"))
    new = A.df.join(r, "i").join(c, "j").groupBy(F.col("_r").alias("i"), F.col("_c").alias("j")).agg(F.min("v").alias("v"))
    base = C
    if accum is None:
        inside = C.df.join(r.select(F.col("_r").alias("i")).distinct(), "i", "left_semi").join(c.select(F.col("_c").alias("j")).distinct(), "j", "left_semi").select("i", "j")
        base = Matrix(C.df.join(inside, ["i", "j"], "left_anti"), C.nrows, C.ncols)
    return _put(base, new, accum)


def assign_column(C: Matrix, u: Vector, col: int, rows: Vector | None = None, accum: BinaryOp | None = None) -> Matrix:
    """C(rows(k), col) = u(k)."""
    if not 0 <= col < C.ncols:
        raise IndexOutOfBounds(col)
    new = u.df if rows is None else index_list(rows).join(u.df, F.col("k") == F.col("i")).groupBy(F.col("x").alias("i")).agg(F.min("v").alias("v"))
    return _put(C, new.select("i", F.lit(col).cast("long").alias("j"), "v"), accum)


def assign_row(C: Matrix, u: Vector, row: int, cols: Vector | None = None, accum: BinaryOp | None = None) -> Matrix:
    """C(row, cols(k)) = u(k)."""
    return assign_column(C.T, u, row, cols, accum).T


def assign_matrix_constant(C: Matrix, value, mask: Matrix, accum: BinaryOp | None = None) -> Matrix:
    """C<mask> = value."""
    kind = dict(C.df.dtypes)["v"]
    return _put(C, mask.true_indices().select("i", "j", F.lit(value).cast(kind).alias("v")), accum)


def scatter(w: Vector, indices: Vector, value, skip_zero: bool = True) -> Vector:
    """w(indices(k)) = value; index 0 means "none" with skip_zero, indices outside w are skipped."""
    kind = dict(w.df.dtypes)["v"]
    at = index_list(indices).where((F.col("x") >= (1 if skip_zero else 0)) & (F.col("x") < w.size)).select(F.col("x").alias("i")).distinct()
    return _put(w, at.select("i", F.lit(value).cast(kind).alias("v")), None)
