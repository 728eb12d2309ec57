"""Numeric column expressions that Spark has no built-in for."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# W. J. Cody's rational approximations of the error function (1969), three ranges.
_A = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
_B = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
_C = (5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8)
_D = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
_P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
_Q = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def _ratio(x, top, bottom):
    """A rational function by Horner's rule; the last coefficient of `top` leads, `bottom` is monic."""
    num, den = top[-1] * x, x
    for t, b in zip(top[:-2], bottom[:-1], strict=True):
        num, den = (num + t) * x, (den + b) * x
    return (num + top[-2]) / (den + bottom[-1])


def erf_float(x: float) -> float:
    """The same approximation on a float; for tests."""
    y = abs(x)
    if y <= 0.46875:
        return x * _ratio(y * y, _A, _B)
    if y <= 4:
        tail = math.exp(-y * y) * _ratio(y, _C, _D)
    else:
        z = 1 / (y * y)
        tail = math.exp(-min(y * y, 700)) / y * (1 / math.sqrt(math.pi) - z * _ratio(z, _P, _Q))
    return math.copysign(1 - tail, x)


def erf(x: Column) -> Column:
    """Error function; stays in whole-stage code, error below 1e-15."""
    y = F.abs(x)
    mid = F.exp(-y * y) * _ratio(y, _C, _D)
    z = 1 / (F.greatest(y, F.lit(4.0)) * F.greatest(y, F.lit(4.0)))
    far = F.exp(-F.least(y * y, F.lit(700.0))) / F.greatest(y, F.lit(4.0)) * (F.lit(1 / math.sqrt(math.pi)) - z * _ratio(z, _P, _Q))
    return F.when(y <= 0.46875, x * _ratio(y * y, _A, _B)).otherwise(F.signum(x) * (1 - F.when(y <= 4, mid).otherwise(far)))


def round_half_away(x: Column, digits: int = 6) -> Column:
    """Decimal rounding by binary arithmetic, the same on every engine."""
    return F.round(x * F.lit(float(10**digits))) / F.lit(float(10**digits))


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1 + erf(z / math.sqrt(2)))
