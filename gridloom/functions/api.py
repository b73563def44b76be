"""The functions of layers that a user calls by name."""

from __future__ import annotations

from collections.abc import Iterable

from gridloom.operators.lists import all_of as all
from gridloom.operators.lists import any_of as any
from gridloom.operators.lists import sum_of as sum
from gridloom.plans.layer import Expression, Layer, as_layer

__all__ = ["abs", "all", "any", "ceil", "clip", "exp", "exp2", "floor", "isin", "log", "log10", "log2", "logical_and", "logical_not", "logical_or", "logical_xor", "maximum", "minimum", "nan_to_num", "round", "sum", "where"]


def where(cond: Layer, a: object, b: object) -> Layer:
    """a where cond isn't 0, else b, over the area of cond."""
    return Expression("where", (cond, a, b))


def maximum(a: object, b: object) -> Layer:
    return Expression("maximum", (a, b))


def minimum(a: object, b: object) -> Layer:
    return Expression("minimum", (a, b))


def logical_and(a: object, b: object) -> Layer:
    return Expression("logical_and", (a, b))


def logical_or(a: object, b: object) -> Layer:
    return Expression("logical_or", (a, b))


def logical_xor(a: object, b: object) -> Layer:
    return Expression("logical_xor", (a, b))


def logical_not(a: object) -> Layer:
    return Expression("logical_not", (a,))


def clip(layer: Layer, min: float | None = None, max: float | None = None) -> Layer:
    return as_layer(layer).clip(min, max)


def isin(layer: Layer, test_elements: Iterable) -> Layer:
    return as_layer(layer).isin(test_elements)


def nan_to_num(layer: Layer, nan: float = 0.0, posinf: float | None = None, neginf: float | None = None) -> Layer:
    return as_layer(layer).nan_to_num(nan, posinf, neginf)


def abs(layer: Layer) -> Layer:
    return as_layer(layer).abs()


def floor(layer: Layer) -> Layer:
    return as_layer(layer).floor()


def ceil(layer: Layer) -> Layer:
    return as_layer(layer).ceil()


def round(layer: Layer) -> Layer:
    return as_layer(layer).round()


def log(layer: Layer) -> Layer:
    return as_layer(layer).log()


def log2(layer: Layer) -> Layer:
    return as_layer(layer).log2()


def log10(layer: Layer) -> Layer:
    return as_layer(layer).log10()


def exp(layer: Layer) -> Layer:
    return as_layer(layer).exp()


def exp2(layer: Layer) -> Layer:
    return as_layer(layer).exp2()
