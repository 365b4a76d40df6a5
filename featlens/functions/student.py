"""Tail of Student's t as a column expression (no Python in the plan).

With ``y = t^2 / (dof + t^2)`` and ``x = 1 - y`` the two-sided tail is the regularised incomplete beta function
``I_x(dof / 2, 1 / 2)``, which has the hypergeometric series

    I_z(a, b) = z^a (1 - z)^b / (a B(a, b)) * sum over n of (a + b)_n / (a + 1)_n * z^n.

For x below a half it is summed as it stands: each term is less than half of the one before. Otherwise its
complement ``I_y(1 / 2, dof / 2)`` is, whose terms first grow if t is large; beyond t = 14 the tail is
below 1e-29 there, and 0 stands for it. ``1 / B(dof / 2, 1 / 2)`` is ``g(dof) / sqrt(pi)`` with
``g(d) = Gamma((d + 1) / 2) / Gamma(d / 2)``; from ``g(d + 2) = g(d) (d + 1) / d`` it is carried up to where its
asymptotic series in 1 / d is exact to the last digits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the two series, steps up the recurrence, and the t beyond which the second case is 0.
TAIL_TERMS, CENTRE_TERMS, STEPS, FAR = 60, 400, 40, 14.0


def _gamma_ratio(d: Column) -> Column:
    """Gamma((d + 1) / 2) / Gamma(d / 2)."""
    top = d + 2.0 * STEPS
    u = 1.0 / top
    series = 1 + u * (-1 / 4 + u * (1 / 32 + u * (5 / 128 + u * (-21 / 2048 - u * 399 / 8192))))
    down = F.aggregate(F.sequence(F.lit(0), F.lit(STEPS - 1)), F.lit(1.0), lambda acc, k: acc * (d + 2.0 * k) / (d + 2.0 * k + 1.0))
    return F.sqrt(top / 2.0) * series * down


def _series(a: Column, b: Column, z: Column, terms: int) -> Column:
    """Sum of (a + b)_n / (a + 1)_n z^n over ``n`` up to ``terms``."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc, n):
        term = acc["term"] * (a + b + n) / (a + n + 1.0) * z
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(terms - 1)), start, add, lambda acc: acc["total"])


def t_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|) for Student's t with ``dof`` degrees of freedom. NULL for a missing t or dof below 1; 0 for an infinite t."""
    t, d = F.abs(t.cast("double")), dof.cast("double")
    square = t * t
    x, y = d / (d + square), square / (d + square)
    scale = _gamma_ratio(d) / math.sqrt(math.pi) * F.exp(-d / 2.0 * F.log1p(square / d)) * F.sqrt(y)
    half = F.lit(0.5)
    tail = scale / (d / 2.0) * _series(d / 2.0, half, x, TAIL_TERMS)
    centre = scale * 2.0 * _series(half, d / 2.0, y, CENTRE_TERMS)
    return (F.when(t.isNull() | F.isnan(t) | d.isNull() | (d < 1), F.lit(None).cast("double"))
            .when(t == float("inf"), 0.0).when(square > d, tail).when(t > FAR, 0.0)
            .otherwise(F.greatest(F.lit(0.0), 1.0 - centre)))
