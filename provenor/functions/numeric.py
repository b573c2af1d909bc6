"""Numeric helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from provenor import constants as K
from provenor.functions.text import _col

# --- fixed values: W. J. Cody (1969), rational Chebyshev approximations for erf and erfc ---
ERF_SMALL_NUM = [
    1.85777706184603153e-1, 3.16112374387056560e00, 1.13864154151050156e02,
    3.77485237685302021e02, 3.20937758913846947e03,
]
ERF_SMALL_DEN = [
    1.0, 2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03,
    2.84423683343917062e03,
]
ERF_MID_NUM = [
    2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e00,
    6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02,
    1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03,
]
ERF_MID_DEN = [
    1.0, 1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02,
    1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03,
    3.43936767414372164e03, 1.23033935480374942e03,
]
ERF_TAIL_NUM = [
    1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1,
    1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4,
]
ERF_TAIL_DEN = [
    1.0, 2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1,
    6.05183413124413191e-2, 2.33520497626869185e-3,
]
ERF_SMALL_LIMIT = 0.46875
ERF_TAIL_LIMIT = 4.0
INV_SQRT_PI = 5.6418958354775628695e-1
SQRT_2 = 1.4142135623730951


def _horner(x: Column, coefficients: Sequence[float]) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, to double precision, as plain arithmetic."""
    sq = x * x
    small = F.lit(1.0) - x * _horner(sq, ERF_SMALL_NUM) / _horner(sq, ERF_SMALL_DEN)
    # exp(-x^2) from a coarse and a fine part keeps the relative error of the tail small
    step = F.floor(x * 16.0) / 16.0
    decay = F.exp(-step * step) * F.exp(-(x - step) * (x + step))
    mid = decay * _horner(x, ERF_MID_NUM) / _horner(x, ERF_MID_DEN)
    inv = F.lit(1.0) / sq
    tail = decay * (F.lit(INV_SQRT_PI) - inv * _horner(inv, ERF_TAIL_NUM) / _horner(inv, ERF_TAIL_DEN)) / x
    return F.when(x <= ERF_SMALL_LIMIT, small).when(x <= ERF_TAIL_LIMIT, mid).otherwise(tail)




def two_sided_p(t: Column) -> Column:
    """Two-sided p-value of ``t`` under the normal approximation; null for null, NaN and infinity."""

    def p_of(z: Column) -> Column:
        # beyond 27.3 the value is below the smallest subnormal double
        return F.when(F.isnan(z) | (z == float("inf")), None).when(z > 27.3, F.lit(0.0)).otherwise(erfc(z))

    # bound once as a lambda variable, so the statistic is not repeated inside the polynomials
    return F.element_at(F.transform(F.array(F.abs(t) / SQRT_2), p_of), 1)


def log2p1(c: Column | str) -> Column:
    return F.log2(_col(c) + 1.0)


def neg_log10(c: Column | str, cap: float = K.NEG_LOG_CAP, plot_cap: float | None = None) -> Column:
    """-log10; values at or below zero give ``cap``; ``plot_cap`` bounds every value."""
    p = _col(c)
    value = F.when(p <= 0, F.lit(cap)).when(p.isNotNull(), -F.log10(p))
    if plot_cap is None:
        return value
    return F.when(value > plot_cap, F.lit(plot_cap)).otherwise(value)


def node_size(c: Column | str) -> Column:
    """Display size of a node, growing with the log of its weight, at most 26."""
    return F.least(F.lit(26.0), F.log1p(_col(c)) * 2.2 + 7.0)


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def similarity(distance: Column | str) -> Column:
    return clamp01(F.lit(1.0) - _col(distance))


def finite_or_null(c: Column | str) -> Column:
    """The value, or null for NaN and both infinities."""
    v = _col(c)
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def ratio(top: Column, bottom: Column) -> Column:
    """Division that yields null for a zero divisor also under ANSI mode."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def zero_if_null(c: Column | str, as_type: str) -> Column:
    return F.coalesce(_col(c).cast(as_type), F.lit(0).cast(as_type))


def blend(weights: Mapping[str, float]) -> Column:
    """Weighted sum of columns, added in the given order."""
    total = None
    for name, weight in weights.items():
        part = F.lit(float(weight)) * F.col(name)
        total = part if total is None else total + part
    return total
