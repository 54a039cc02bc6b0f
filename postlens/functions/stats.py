"""Student-t distribution as Spark expressions (no scipy, no UDF).

With θ = atan(|t|/√ν) the two-sided p-value is
    p = ∫_θ^{π/2} cos^{ν-1}(x) dx / ∫_0^{π/2} cos^{ν-1}(x) dx
(the Gamma terms cancel).  Both integrals use Simpson's rule over an interval
cut at 14/√ν, where the integrand is negligible.  The quantile is found by
bisection on that p-value.  These only ever run on aggregated result rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 400        # Simpson panels (even)
BISECT = 110       # bisection steps for the quantile
T_START = 50.0     # first upper bound of the bisection; doubled while p is above the target
DOUBLINGS = 60

# Effect-size bands of |d| and their labels.
EFFECT_BANDS = ((0.2, "Negligible"), (0.5, "Small"), (0.8, "Medium"), (1.2, "Large"))
EFFECT_TOP = "Very Large"


def _simpson(a: Column, b: Column, nu: Column, steps: int = STEPS) -> Column:
    h = (b - a) / steps

    def step(acc, i):
        w = (F.when((i == 0) | (i == steps), F.lit(1.0))
             .when(i % 2 == 1, F.lit(4.0)).otherwise(F.lit(2.0)))
        return acc + w * F.pow(F.greatest(F.cos(a + i * h), F.lit(0.0)), nu - 1)

    return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), step) * h / 3


def t_two_sided_p(t: Column, nu: Column) -> Column:
    """Two-sided p-value of Student's t with ``nu`` (real) degrees of freedom."""
    nu = nu.cast("double")
    theta = F.atan(F.abs(t) / F.sqrt(nu))
    cut = F.least(F.lit(math.pi / 2), F.lit(14.0) / F.sqrt(nu))
    num = F.when(theta >= cut, F.lit(0.0)).otherwise(_simpson(theta, cut, nu))
    return num / _simpson(F.lit(0.0), cut, nu)


def t_quantile(prob: float, nu: Column) -> Column:
    """Upper quantile ``t.ppf(prob, nu)`` for prob > .5, by bisection on p."""
    target = 2 * (1 - prob)
    nu = nu.cast("double")

    def step(acc, _k):
        mid = (acc["lo"] + acc["hi"]) / 2
        p = t_two_sided_p(mid, nu)
        return F.when(p > target, F.struct(mid.alias("lo"), acc["hi"].alias("hi"))) \
                .otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))

    top = F.aggregate(F.sequence(F.lit(1), F.lit(DOUBLINGS)), F.lit(T_START),
                      lambda hi, _k: F.when(t_two_sided_p(hi, nu) > target, hi * 2).otherwise(hi))
    init = F.struct(F.lit(0.0).alias("lo"), top.alias("hi"))
    r = F.aggregate(F.sequence(F.lit(1), F.lit(BISECT)), init, step)
    return (r["lo"] + r["hi"]) / 2


def effect_label(d: Column) -> Column:
    """H4: Negligible / Small / Medium / Large / Very Large by |d|."""
    a = F.abs(d)
    chain = None
    for hi, lab in EFFECT_BANDS:
        chain = F.when(a < hi, lab) if chain is None else chain.when(a < hi, lab)
    return chain.otherwise(EFFECT_TOP)
