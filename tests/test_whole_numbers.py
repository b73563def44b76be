"""Whole numbers are exact and wrap round as 64-bit arrays do."""

import numpy as np
import pytest

import gridloom as g
from gridloom import MapProjection

P = MapProjection("ESRI:54009", 1.0, -1.0)
TOP, LOW = 2**63 - 1, -(2**63)
X = np.array([[0, 1, -1, 2, -3, 7, 94906267, -94906267, 2**53 + 1, -(2**53) - 1, TOP, LOW, TOP - 1, LOW + 1, 3037000500, 10**18 + 7]])
Y = np.array([[1, -1, -1, 5, 2, -2, 94906267, 3, 1, 7, 1, -1, TOP, LOW, 3037000500, 10]])

CASES = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "floordiv": lambda a, b: a // b, "mod": lambda a, b: a % b, "neg": lambda a, b: -a,
    "rsub": lambda a, b: 5 - a, "square": lambda a, b: a**2, "cube": lambda a, b: a**3, "zeroth": lambda a, b: a**0, "high": lambda a, b: a**63, "by_one": lambda a, b: a // -1, "by_seven": lambda a, b: a // 7,
}


@pytest.mark.parametrize("name", CASES)
def test_as_numpy(spark, name):
    with np.errstate(all="ignore"):
        expected = CASES[name](X, Y)
    got = CASES[name](g.from_array(X, (0, 0), P), g.from_array(Y, (0, 0), P)).array()
    assert got.dtype == np.int64 and got.tolist() == expected.tolist()


def test_abs(spark):
    assert g.abs(g.from_array(X, (0, 0), P)).array().tolist() == np.abs(X).tolist()


def test_powers(spark):
    x, y = np.array([[2, 3, -2, -1, 1, 0, 5, 10]]), np.array([[62, 39, 63, -3, -2, -1, -1, 18]])
    assert (g.from_array(x, (0, 0), P) ** g.from_array(y, (0, 0), P)).array().tolist() == [[2**62, 3**39, -(2**63), -1, 1, 0, 0, 10**18]]


def test_by_zero(spark):
    x = g.from_array(X, (0, 0), P)
    assert not (x // 0).array().any() and not (x % 0).array().any()
