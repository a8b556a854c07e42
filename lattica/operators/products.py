"""Products over a semiring: joins followed by an aggregate.

Masks act on the output key before the aggregate, so what they rule out is neither
shuffled for it nor summed; a product of matrices under a mask starts from the mask, in cells of a grid. Partial aggregation comes before the shuffle in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.errors import UninitializedObject
from lattica.functions.algebra import BinaryOp, Semiring, UnaryOp
from lattica.operators.cells import terms
from lattica.operators.objects import DEFAULT, Descriptor, Matrix, Vector, _same
from lattica.operators.output import masked, write

#: Entries of a vector that push mode broadcasts at most.
BROADCAST_ROWS = 1_000_000


def _given(*objects) -> None:
    if any(o is None for o in objects):
        raise UninitializedObject("an operand is missing")


def _hinted(u: DataFrame, mode: str) -> DataFrame:
    if mode == "push" and u.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return F.broadcast(u)
    return u.hint("merge") if mode == "pull" else u


def _product(A: Matrix, u: Vector, inner: str, outer: str, semiring: Semiring, flipped: bool, mask, accum, w, desc: Descriptor, u_fn: UnaryOp | None = None) -> Vector:
    _same("inner sizes", A.ncols if inner == "j" else A.nrows, u.size)
    size = A.nrows if outer == "i" else A.ncols
    if mask is not None:
        _same("mask", mask.size, size)
    right = u.df.select(F.col("i").alias("_k"), (u_fn(F.col("v")) if u_fn else F.col("v")).alias("_u"))
    e = A.df.select(F.col(inner).alias("_k"), F.col(outer).alias("i"), F.col("v").alias("_a"))
    p = masked(e, mask, ("i",), desc).join(_hinted(right, desc.mode), "_k")
    term: Column = semiring.mul(F.col("_u"), F.col("_a")) if flipped else semiring.mul(F.col("_a"), F.col("_u"))
    t = semiring.add.over(p, ("i",), term)
    return Vector(write(t, ("i",), w.df if w else None, mask, accum, desc), size)


def mxv(A: Matrix, u: Vector, semiring: Semiring, mask: Vector | None = None, accum: BinaryOp | None = None, w: Vector | None = None, desc: Descriptor = DEFAULT) -> Vector:
    """w<mask> = accum(w, A u): for each row i, the sum over j of mul(A(i,j), u(j)). tran0 uses A's transpose.

    An empty vector gives an empty result. Rows without a term have no entry.
    """
    _given(A, u)
    inner, outer = ("i", "j") if desc.tran0 else ("j", "i")
    return _product(A, u, inner, outer, semiring, False, mask, accum, w, desc)


def vxm(u: Vector, A: Matrix, semiring: Semiring, mask: Vector | None = None, accum: BinaryOp | None = None, w: Vector | None = None, desc: Descriptor = DEFAULT) -> Vector:
    """w<mask> = accum(w, u A): for each column j, the sum over i of mul(u(i), A(i,j)). tran1 uses A's transpose."""
    _given(u, A)
    inner, outer = ("j", "i") if desc.tran1 else ("i", "j")
    return _product(A, u, inner, outer, semiring, True, mask, accum, w, desc)


def apply_vxm(fn: UnaryOp, u: Vector, A: Matrix, semiring: Semiring, mask: Vector | None = None, accum: BinaryOp | None = None, w: Vector | None = None, desc: Descriptor = DEFAULT) -> Vector:
    """vxm of fn(u), in one plan."""
    _given(u, A)
    inner, outer = ("j", "i") if desc.tran1 else ("i", "j")
    return _product(A, u, inner, outer, semiring, True, mask, accum, w, desc, fn)


def mxm(A: Matrix, B: Matrix, semiring: Semiring, mask: Matrix | None = None, accum: BinaryOp | None = None, C: Matrix | None = None, desc: Descriptor = DEFAULT, keep_pattern: bool = True) -> Matrix:
    """C<mask> = accum(C, A B). tran0 and tran1 use A's and B's transposes.

    With a mask (not complemented) and keep_pattern, the result has exactly the mask's stored
    pattern; where no term falls or the mask is 0, the value is the identity.
    """
    _given(A, B)
    a, b = A.T if desc.tran0 else A, B.T if desc.tran1 else B
    _same("inner sizes", a.ncols, b.nrows)
    if mask is not None:
        _same("mask rows", mask.nrows, a.nrows)
        _same("mask columns", mask.ncols, b.ncols)
    left = a.df.select("i", F.col("j").alias("_k"), F.col("v").alias("_a"))
    right = b.df.select(F.col("i").alias("_k"), "j", F.col("v").alias("_b"))
    if mask is None or desc.complement:
        p = masked(left.join(right, "_k"), mask, ("i", "j"), desc)
    else:  # from the mask's entries to A's row or B's column, within cells of a grid: terms that the mask rules out are never rows
        p = terms(mask.true_indices(), left, right)
    t = semiring.add.over(p, ("i", "j"), semiring.mul(F.col("_a"), F.col("_b")))
    if mask is not None and keep_pattern and not desc.complement and accum is None:
        kind = dict(t.dtypes)["v"]
        t = mask.df.select("i", "j").join(t, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(semiring.add.identity_of(kind)).cast(kind)).alias("v"))
    return Matrix(write(t, ("i", "j"), C.df if C else None, mask, accum, desc), a.nrows, b.ncols)


def trace_mxm_transpose(semiring: Semiring, A: Matrix, B: Matrix):
    """Trace of A Bt: sum of mul(A(i,j), B(i,j)); the sum's identity if the patterns don't meet."""
    return trace_mxm_transpose_df(semiring, A, B).first()[0]


def trace_mxm_transpose_df(semiring: Semiring, A: Matrix, B: Matrix) -> DataFrame:
    _given(A, B)
    _same("rows", A.nrows, B.nrows)
    _same("columns", A.ncols, B.ncols)
    p = A.df.select("i", "j", F.col("v").alias("_a")).join(B.df.select("i", "j", F.col("v").alias("_b")), ["i", "j"])
    return semiring.add.over(p, (), semiring.mul(F.col("_a"), F.col("_b")))


def trace_mxm_df(semiring: Semiring, A: Matrix, B: Matrix) -> DataFrame:
    """Trace of A B: the same with B's transpose."""
    return trace_mxm_transpose_df(semiring, A, B.T)
