"""Binary and unary operators, monoids and semirings, as builders of Column expressions.

All stay within Catalyst: an operator is a function of Columns, a monoid adds an aggregate.
User-defined ones take the same form.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.errors import InvalidValue

#: Stands for "unreachable" where a number must: the largest 32-bit float.
INFINITY = 3.4028234663852886e38
LARGEST = (1 << 63) - 1
#: Values that a monoid of the caller's folds at a time, about.
PART = 1024


@dataclass(frozen=True)
class BinaryOp:
    name: str
    fn: Callable[[Column, Column], Column]

    def __call__(self, a: Column, b: Column) -> Column:
        return self.fn(a, b)


@dataclass(frozen=True)
class UnaryOp:
    name: str
    fn: Callable[[Column], Column]

    def __call__(self, a: Column) -> Column:
        return self.fn(a)


def _truth(c: Column) -> Column:
    return c.cast("long")


def _divide(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is an infinity, 0/0 is NaN."""
    a, b = a.cast("double"), b.cast("double")
    inf = F.lit(float("inf"))
    return F.when(b == 0, F.when(a > 0, inf).when(a < 0, -inf).otherwise(F.lit(float("nan")))).otherwise(F.try_divide(a, b))


_BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "logical_or": lambda a, b: _truth((a != 0) | (b != 0)),
    "logical_and": lambda a, b: _truth((a != 0) & (b != 0)),
    "logical_xor": lambda a, b: _truth((a != 0) != (b != 0)),
    "equal": lambda a, b: _truth(a == b),
    "not_equal_to": lambda a, b: _truth(a != b),
    "greater": lambda a, b: _truth(a > b),
    "less": lambda a, b: _truth(a < b),
    "greater_equal": lambda a, b: _truth(a >= b),
    "less_equal": lambda a, b: _truth(a <= b),
    "first": lambda a, b: a,
    "second": lambda a, b: b,
    "select_second": lambda a, b: b,
    "minimum": lambda a, b: F.least(a, b),
    "maximum": lambda a, b: F.greatest(a, b),
    "plus": lambda a, b: a + b,
    "minus": lambda a, b: a - b,
    "multiplies": lambda a, b: a * b,
    "divides": _divide,
}
BINARY = {k: BinaryOp(k, f) for k, f in _BINARY.items()}


def hash_weight(seed: int = 0) -> UnaryOp:
    """A pseudo-random positive integer of an index, the same on every recomputation."""
    return UnaryOp("hash_weight", lambda i: F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(2**40)) + 1)


def uniform_int(low: int, high: int, seed: int = 0) -> UnaryOp:
    """An integer in [low, high], hashed from an index."""
    if high < low:
        raise InvalidValue("an empty range")
    return UnaryOp("uniform_int", lambda i: F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(high - low + 1)) + low)


UNARY = {
    "identity": UnaryOp("identity", lambda a: a),
    "negate": UnaryOp("negate", lambda a: -a),
    "absolute": UnaryOp("absolute", F.abs),
    "one": UnaryOp("one", lambda a: F.lit(1).cast("long")),
    "not": UnaryOp("not", lambda a: _truth(a == 0)),
    "inverse": UnaryOp("inverse", lambda a: _divide(F.lit(1.0), a)),
    "square_root": UnaryOp("square_root", F.sqrt),
}


@dataclass(frozen=True)
class Monoid:
    """A binary operator with its identity; reduce is the aggregate, None if the operator is not associative."""

    name: str
    op: BinaryOp
    identity: float | int
    reduce: Callable[[Column], Column] | None = None
    #: The operator is the caller's: it has no aggregate of Spark's.
    own: bool = False

    def identity_of(self, kind: str) -> float | int:
        """The identity among values of a type: the largest 64-bit integer stands for "unreachable" among integers."""
        return LARGEST if self.identity == INFINITY and kind == "bigint" else self.identity

    def over(self, df: DataFrame, keys: Sequence[str], term: Column) -> DataFrame:
        """(keys, v): the monoid over term for each key that df has; without keys one row, the identity if df has none.

        Integers stay 64-bit integers, but for products, which Spark sums up as doubles.
        """
        if self.reduce is None and not self.own:
            raise InvalidValue(f"{self.name} is not associative, so it can't reduce")
        d = df.select(*keys, term.alias("v"))
        kind = dict(d.dtypes)["v"]
        out = self._folded(d, keys, kind) if self.own else d.groupBy(*keys).agg(self.reduce(F.col("v")).alias("v"))
        return out if keys else out.select(F.coalesce("v", F.lit(self.identity_of(kind)).cast(dict(out.dtypes)["v"])).alias("v"))

    def _folded(self, d: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
        """Groups are folded in parts of about PART values, then the parts, and so on, so no task gathers a whole large group."""
        largest = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        fold = F.reduce(F.collect_list("v"), F.lit(self.identity_of(kind)).cast(kind), lambda x, y: self.op(x, y).cast(kind))
        parts, place = -(-largest // PART), F.monotonically_increasing_id()
        while parts > 1:
            d = d.withColumn("_part", F.pmod(F.xxhash64(place), F.lit(parts))).groupBy(*keys, "_part").agg(fold.alias("v"))
            parts, place = -(-parts // PART), F.col("_part")
        return d.groupBy(*keys).agg(fold.alias("v"))

    @staticmethod
    def custom(name: str, op: BinaryOp, identity: float | int) -> Monoid:
        """Any associative and commutative operator."""
        return Monoid(name, op, identity, own=True)


MONOID = {
    m.name: m
    for m in (
        Monoid("plus", BINARY["plus"], 0, F.sum),
        Monoid("multiplies", BINARY["multiplies"], 1, F.product),
        Monoid("minimum", BINARY["minimum"], INFINITY, F.min),
        # its identity is 0, so it is a floor
        Monoid("maximum", BINARY["maximum"], 0, lambda c: F.greatest(F.lit(0), F.max(c))),
        Monoid("logical_or", BINARY["logical_or"], 0, lambda c: F.bool_or(c != 0).cast("long")),
        Monoid("logical_and", BINARY["logical_and"], 1, lambda c: F.bool_and(c != 0).cast("long")),
        Monoid("greater", BINARY["greater"], 0),
        Monoid("custom_less", BINARY["less"], INFINITY),
        Monoid("not_equal_to", BINARY["not_equal_to"], INFINITY),
    )
}


@dataclass(frozen=True)
class Semiring:
    name: str
    add: Monoid
    mul: BinaryOp


def _semiring(name: str, add: str, mul: str) -> Semiring:
    return Semiring(name, MONOID[add], BINARY[mul])


SEMIRING = {
    s.name: s
    for s in (
        _semiring("or_and", "logical_or", "logical_and"),
        _semiring("plus_times", "plus", "multiplies"),
        _semiring("min_plus", "minimum", "plus"),
        _semiring("max_times", "maximum", "multiplies"),
        _semiring("plus_divides", "plus", "divides"),
        _semiring("plus_greater", "plus", "greater"),
        _semiring("greater_plus", "greater", "plus"),
        _semiring("plus_minus", "plus", "minus"),
        _semiring("plus_less", "plus", "less"),
        _semiring("custom_less_plus", "custom_less", "plus"),
        _semiring("min_times", "minimum", "multiplies"),
        _semiring("times_times", "multiplies", "multiplies"),
        _semiring("not_equal_plus", "not_equal_to", "plus"),
        _semiring("min_second", "minimum", "select_second"),
        _semiring("plus_not_equal", "plus", "not_equal_to"),
        _semiring("custom_less_less", "custom_less", "less"),
        _semiring("min_not_equal", "minimum", "not_equal_to"),
    )
}
