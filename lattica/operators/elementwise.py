"""Element by element: multiplication on the intersection of patterns, addition on their union, apply, scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.algebra import BINARY, BinaryOp, Monoid, Semiring, UnaryOp
from lattica.operators.objects import DEFAULT, Descriptor, Matrix, Vector, _same
from lattica.operators.output import masked, write
from lattica.operators.products import _given


def _op(x: Semiring | BinaryOp | Monoid, part: str) -> BinaryOp:
    if isinstance(x, Semiring):
        return x.mul if part == "mul" else x.add.op
    return x.op if isinstance(x, Monoid) else x


def _pair(a: DataFrame, b: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    return a.select(*keys, F.col("v").alias("_a")).join(b.select(*keys, F.col("v").alias("_b")), list(keys), how)


def ewise_mult(u, v, op: Semiring | BinaryOp, mask=None, accum: BinaryOp | None = None, w=None, desc: Descriptor = DEFAULT):
    """op on entries that both have. The right side may be a number, or for a matrix a vector.

    A matrix and a vector: C(i,j) = op(A(i,j), v(i)), with tran1 v(j).
    """
    _given(u, v)
    f = _op(op, "mul")
    if isinstance(v, Vector) and isinstance(u, Matrix):
        along = "j" if desc.tran1 else "i"
        _same("vector", v.size, u.ncols if desc.tran1 else u.nrows)
        p = u.df.join(v.df.select(F.col("i").alias(along), F.col("v").alias("_b")), along)
        t, keys = p.select("i", "j", f(F.col("v"), F.col("_b")).alias("v")), ("i", "j")
    else:
        keys = ("i", "j") if isinstance(u, Matrix) else ("i",)
        if isinstance(v, (Vector, Matrix)):
            _check(u, v)
            p = _pair(masked(u.df, mask, keys, desc), v.df, keys, "inner")
            t = p.select(*keys, f(F.col("_a"), F.col("_b")).alias("v"))
        else:
            t = u.df.select(*keys, f(F.col("v"), F.lit(v)).alias("v"))
    t = masked(t, mask, keys, desc)
    return _like(u, write(t, keys, w.df if w else None, mask, accum, desc))


def ewise_add(u, v, op: Semiring | Monoid | BinaryOp, identity=None, mask=None, accum: BinaryOp | None = None, w=None, desc: Descriptor = DEFAULT, keep_single: bool = False):
    """op on entries that either has; a missing one counts as the identity, always in the order op(u, v).

    A monoid or semiring brings its identity; a bare operator needs one. With keep_single, an entry that only one side
    has is taken as it is. The right side may be a number: op(u, number) on stored entries,
    densify first if absent ones count.
    """
    _given(u, v)
    monoid = op.add if isinstance(op, Semiring) else op if isinstance(op, Monoid) else None
    kind = dict(u.df.dtypes)["v"]
    f, zero = _op(op, "add"), identity if identity is not None else monoid.identity_of(kind) if monoid else 0
    keys = ("i", "j") if isinstance(u, Matrix) else ("i",)
    if isinstance(v, (Vector, Matrix)):
        _check(u, v)
        p = masked(_pair(u.df, v.df, keys, "full_outer"), mask, keys, desc)
        a, b = F.coalesce(F.col("_a"), F.lit(zero)), F.coalesce(F.col("_b"), F.lit(zero))
        out = f(a, b)
        if keep_single:
            out = F.when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_a")).otherwise(out)
        t = p.select(*keys, out.alias("v"))
    else:
        t = masked(u.df.select(*keys, f(F.col("v"), F.lit(v)).alias("v")), mask, keys, desc)
    return _like(u, write(t, keys, w.df if w else None, mask, accum, desc))


def apply(fn: UnaryOp, u, mask=None, accum: BinaryOp | None = None, w=None, desc: Descriptor = DEFAULT):
    """fn on every stored value."""
    _given(u)
    keys = ("i", "j") if isinstance(u, Matrix) else ("i",)
    t = masked(u.df, mask, keys, desc).select(*keys, fn(F.col("v")).alias("v"))
    return _like(u, write(t, keys, w.df if w else None, mask, accum, desc))


def scale(u, value, op: BinaryOp = BINARY["multiplies"]):
    """op(stored value, value)."""
    return apply(UnaryOp("scale", lambda c: op(c, F.lit(value))), u)


def _check(u, v) -> None:
    if isinstance(u, Matrix):
        _same("rows", u.nrows, v.nrows)
        _same("columns", u.ncols, v.ncols)
    else:
        _same("sizes", u.size, v.size)


def _like(u, df: DataFrame):
    return Matrix(df, u.nrows, u.ncols) if isinstance(u, Matrix) else Vector(df, u.size)
