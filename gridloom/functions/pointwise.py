"""Pixel-wise operators as Spark columns.

Each takes and returns ``Value``: a column and its kind (``b`` boolean, ``i`` whole number held as bigint, ``f``
double).  Where Spark's own functions differ from IEEE arithmetic (errors on division by zero, NULL logarithms, NaN
that equals and exceeds everything) they are guarded, so that NaN alone stands for missing data and no NULL arises.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
LEAST, WRAP = -(1 << 63), 1 << 64


class Footprint(Enum):
    """Which area an operator's result has: of both, of what both share, or of the first operand."""

    UNION = "union"
    INTERSECTION = "intersection"
    FIRST = "first"


@dataclass(frozen=True)
class Value:
    column: Column
    kind: str

    @property
    def number(self) -> Column:
        """As a number: booleans become 0 and 1."""
        return self.column.cast("bigint") if self.kind == "b" else self.column

    @property
    def double(self) -> Column:
        return self.number.cast("double")

    @property
    def truth(self) -> Column:
        return self.column if self.kind == "b" else self.column != 0

    @property
    def is_nan(self) -> Column:
        return F.isnan(self.column) if self.kind == "f" else F.lit(False)


def _pair(a: Value, b: Value) -> tuple[Column, Column, str]:
    """Both as doubles if either is one, else both as whole numbers."""
    if "f" in (a.kind, b.kind):
        return a.double, b.double, "f"
    return a.number, b.number, "i"


def _wrapped(f: Callable[[Column, Column], Column], x: Column, y: Column) -> Column:
    """f of whole numbers exactly, as 64 bits hold it: what goes over the end comes in at the other."""
    exact = f(x.cast("decimal(19,0)"), y.cast("decimal(19,0)")).cast("decimal(38,0)")
    half, whole = (F.lit(str(n)).cast("decimal(38,0)") for n in (-LEAST, WRAP))
    return (F.pmod((exact + half).cast("decimal(38,0)"), whole) - half).cast("bigint")


def _arithmetic(f: Callable[[Column, Column], Column], tried: Callable[[Column, Column], Column]):
    """tried: f of whole numbers, NULL beyond 64 bits."""

    def op(a: Value, b: Value) -> Value:
        x, y, kind = _pair(a, b)
        return Value(f(x, y) if kind == "f" else F.coalesce(tried(x, y), _wrapped(f, x, y)), kind)

    return op


_add = _arithmetic(lambda x, y: x + y, F.try_add)
_sub = _arithmetic(lambda x, y: x - y, F.try_subtract)
_mul = _arithmetic(lambda x, y: x * y, F.try_multiply)


def _divide(x: Column, y: Column) -> Column:
    safe = F.when(y != 0, y)
    zero = F.when(F.isnan(x) | (x == 0), F.lit(NAN)).otherwise(F.signum(x) * F.lit(INF))
    return F.when(F.isnan(y), F.lit(NAN)).when(y == 0, zero).otherwise(x / safe)


def _truediv(a: Value, b: Value) -> Value:
    return Value(_divide(a.double, b.double), "f")


def _floor(x: Column) -> Column:
    """floor of a double as a double; values too large for bigint have no fraction."""
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(F.floor(x).cast("double"))


def _ceil(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(F.ceil(x).cast("double"))


def _mod(a: Value, b: Value) -> Value:
    """Remainder with the divisor's sign; by zero NaN, for whole numbers 0."""
    x, y, kind = _pair(a, b)
    if kind == "i":
        safe = F.when((y != 0) & (y != -1), y)
        rest = x % safe
        return Value(F.when((y == 0) | (y == -1), F.lit(0)).when((rest != 0) & ((rest < 0) != (safe < 0)), rest + safe).otherwise(rest).cast("bigint"), kind)
    safe = F.when(y != 0, y)
    rest = (x % safe + y) % safe
    return Value(F.when(F.isnan(x) | F.isnan(y) | (y == 0) | (F.abs(x) == INF), F.lit(NAN)).when(F.abs(y) == INF, F.when((x == 0) | (F.signum(x) == F.signum(y)), x).otherwise(y)).otherwise(rest), kind)


def _floordiv(a: Value, b: Value) -> Value:
    """Quotient rounded down; by zero as for division, for whole numbers 0."""
    x, y, kind = _pair(a, b)
    if kind == "f":
        return Value(_floor(_divide(x, y)), kind)
    safe = F.when((y != 0) & (y != -1), y)
    down = F.call_function("div", x, safe) - F.when((x % safe != 0) & ((x < 0) != (safe < 0)), 1).otherwise(0)
    return Value(F.when(y == 0, F.lit(0)).when(y == -1, _negative(x)).otherwise(down).cast("bigint"), kind)


def _negative(x: Column) -> Column:
    """-x of whole numbers; the least one has no opposite and stays."""
    return F.when(x == LEAST, x).otherwise(-F.when(x != LEAST, x))


def _power(a: Value, b: Value) -> Value:
    """Whole numbers are exact as 64 bits hold them; to negative powers 0, but for the bases 1 and -1."""
    x, y, kind = _pair(a, b)
    if kind == "f":
        return Value(F.pow(x, y), kind)
    near = F.pow(x.cast("double"), y.cast("double"))

    def times(p: Column, q: Column) -> Column:
        return F.coalesce(F.try_multiply(p, q), _wrapped(lambda m, n: m * n, p, q))

    def step(acc: Column, i: Column) -> Column:
        bit = F.call_function("shiftright", y, i).bitwiseAND(F.lit(1)) == 1
        return F.struct(F.when(bit, times(acc["out"], acc["base"])).otherwise(acc["out"]).alias("out"), times(acc["base"], acc["base"]).alias("base"))

    bits = F.sequence(F.lit(0), F.greatest(F.length(F.bin(y)) - 1, F.lit(0)))
    exact = F.aggregate(bits, F.struct(F.lit(1).cast("bigint").alias("out"), x.alias("base")), step, lambda acc: acc["out"])
    negative = F.when(x == 1, 1).when(x == -1, F.when(y % 2 == 0, 1).otherwise(-1)).otherwise(0)
    return Value(F.when(y < 0, negative).when(F.abs(near) < 2.0**52, F.rint(F.when(F.abs(near) < 2.0**52, near)).cast("bigint")).otherwise(exact).cast("bigint"), "i")


def _compare(f: Callable[[Column, Column], Column], nan_operand: Callable[[Value, Value], Column], if_nan: bool = False):
    """nan_operand: where the result is ``if_nan`` whatever Spark's order says."""

    def op(a: Value, b: Value) -> Value:
        x, y, kind = _pair(a, b)
        if kind == "i":
            return Value(f(x, y), "b")
        nan = nan_operand(a, b)
        return Value((f(x, y) | nan) if if_nan else (f(x, y) & ~nan), "b")

    return op


def _bits(boolean: Callable[[Column, Column], Column], number: Callable[[Column, Column], Column]):
    def op(a: Value, b: Value) -> Value:
        if "f" in (a.kind, b.kind):
            raise TypeError("bitwise operators need whole numbers")
        if a.kind == b.kind == "b":
            return Value(boolean(a.column, b.column), "b")
        return Value(number(a.number, b.number), "i")

    return op


def _shift(name: str):
    def op(a: Value, b: Value) -> Value:
        if "f" in (a.kind, b.kind):
            raise TypeError("shifts need whole numbers")
        return Value(F.call_function(name, a.number, b.number.cast("int")), "i")

    return op


def _greatest(a: Value, b: Value) -> Value:
    x, y, kind = _pair(a, b)
    return Value(F.greatest(x, y), kind)  # NaN is the greatest, as it should


def _least(a: Value, b: Value) -> Value:
    x, y, kind = _pair(a, b)
    if kind == "i":
        return Value(F.least(x, y), kind)
    return Value(F.when(a.is_nan | b.is_nan, F.lit(NAN)).otherwise(F.least(x, y)), kind)


def _logic(f: Callable[[Column, Column], Column]):
    return lambda a, b: Value(f(a.truth, b.truth), "b")


def _where(cond: Value, a: Value, b: Value) -> Value:
    if a.kind == b.kind == "b":
        return Value(F.when(cond.truth, a.column).otherwise(b.column), "b")
    x, y, kind = _pair(a, b)
    return Value(F.when(cond.truth, x).otherwise(y), kind)


def _whole(f: Callable[[Column], Column]):
    return lambda a: Value(f(a.column), "f") if a.kind == "f" else Value(a.number, "i")


def _log(f: Callable[[Column], Column]):
    def op(a: Value) -> Value:
        x = a.double
        return Value(F.when(F.isnan(x), F.lit(NAN)).when(x > 0, f(x)).when(x == 0, F.lit(-INF)).otherwise(F.lit(NAN)), "f")

    return op


def _same_kind(f: Callable[[Column], Column], whole: Callable[[Column], Column]):
    return lambda a: Value(f(a.column), "f") if a.kind == "f" else Value(whole(a.number), "i")


def _nan_to_num(a: Value, nan: float = 0.0, posinf: float | None = None, neginf: float | None = None) -> Value:
    if a.kind != "f":
        return a
    top = posinf if posinf is not None else 1.7976931348623157e308
    low = neginf if neginf is not None else -1.7976931348623157e308
    x = a.column
    return Value(F.when(F.isnan(x), F.lit(float(nan))).when(x == INF, F.lit(float(top))).when(x == -INF, F.lit(float(low))).otherwise(x), "f")


def _isin(a: Value, elements: tuple) -> Value:
    wanted = [e for e in elements if not (isinstance(e, float) and math.isnan(e))]
    found = a.number.isin(*wanted) if wanted else F.lit(False)
    return Value(found & ~a.is_nan if a.kind == "f" else found, "b")


def _clip(a: Value, low: float | None = None, high: float | None = None) -> Value:
    floats = a.kind == "f" or any(isinstance(v, float) for v in (low, high))
    x = a.double if floats else a.number
    out = x if low is None else F.greatest(x, F.lit(low).cast("double" if floats else "bigint"))
    out = out if high is None else F.least(out, F.lit(high).cast("double" if floats else "bigint"))
    return Value(F.when(F.isnan(x), x).otherwise(out) if floats else out, "f" if floats else "i")


U, I, N = Footprint.UNION, Footprint.INTERSECTION, Footprint.FIRST  # noqa: E741
_both_nan = lambda a, b: a.is_nan | b.is_nan


@dataclass(frozen=True)
class Operator:
    """name, kernel, footprint; keeps_zero: it gives 0 where all its operands are 0."""

    name: str
    kernel: Callable[..., Value]
    footprint: Footprint
    keeps_zero: bool


OPERATORS: dict[str, Operator] = {
    name: Operator(name, kernel, footprint, keeps)
    for name, kernel, footprint, keeps in (
        ("add", _add, U, True),
        ("sub", _sub, U, True),
        ("mul", _mul, I, True),
        ("truediv", _truediv, I, False),
        ("floordiv", _floordiv, I, False),
        ("mod", _mod, I, False),
        ("pow", _power, U, False),
        ("eq", _compare(lambda x, y: x == y, _both_nan), I, False),
        ("ne", _compare(lambda x, y: x != y, _both_nan, True), U, True),
        ("lt", _compare(lambda x, y: x < y, _both_nan), U, True),
        ("le", _compare(lambda x, y: x <= y, _both_nan), U, False),
        ("gt", _compare(lambda x, y: x > y, _both_nan), U, True),
        ("ge", _compare(lambda x, y: x >= y, _both_nan), U, False),
        ("bit_and", _bits(lambda x, y: x & y, lambda x, y: x.bitwiseAND(y)), I, True),
        ("bit_or", _bits(lambda x, y: x | y, lambda x, y: x.bitwiseOR(y)), U, True),
        ("lshift", _shift("shiftleft"), I, True),
        ("rshift", _shift("shiftright"), I, True),
        ("logical_and", _logic(lambda x, y: x & y), I, True),
        ("logical_or", _logic(lambda x, y: x | y), U, True),
        ("logical_xor", _logic(lambda x, y: x != y), U, True),
        ("logical_not", lambda a: Value(~a.truth, "b"), N, False),
        ("maximum", _greatest, U, True),
        ("minimum", _least, U, True),
        ("where", _where, N, True),
        ("abs", _same_kind(F.abs, lambda x: F.when(x < 0, _negative(x)).otherwise(x)), N, True),
        ("neg", _same_kind(lambda x: -x, _negative), N, True),
        ("pos", _same_kind(lambda x: x, lambda x: x), N, True),
        ("floor", _whole(_floor), N, True),
        ("ceil", _whole(_ceil), N, True),
        ("round", _whole(F.rint), N, True),
        ("log", _log(F.ln), N, False),
        ("log2", _log(F.log2), N, False),
        ("log10", _log(F.log10), N, False),
        ("exp", lambda a: Value(F.exp(a.double), "f"), N, False),
        ("exp2", lambda a: Value(F.pow(F.lit(2.0), a.double), "f"), N, False),
        ("isnan", lambda a: Value(a.is_nan, "b"), N, True),
        ("nan_to_num", _nan_to_num, N, True),
        ("isin", _isin, N, False),
        ("clip", _clip, N, False),
        ("as_type", lambda a, datatype: Value(datatype.converted(a.number, a.kind == "f"), "f" if datatype.is_float else "i"), N, True),
    )
}
