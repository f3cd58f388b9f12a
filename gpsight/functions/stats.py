"""Pearson correlation test as Spark column expressions (no Python in the data path).

The test statistics follow ``cor.test`` in R:

    r  = s_xy / sqrt(s_xx * s_yy)              (pairs with a NULL on either side dropped)
    df = n - 2,  t = r * sqrt(df / (1 - r^2))
    p  = P(|T_df| > |t|)                       (two-sided)
    CI = tanh(atanh(r) -/+ z_{0.975} / sqrt(n - 3))   for n > 3

Spark has no Student-t distribution function. With theta = atan(|t| / sqrt(df)), the
two-sided tail is a ratio of two integrals of a smooth function:

    p = int_theta^{pi/2} cos(phi)^(df-1) dphi  /  int_0^{pi/2} cos(phi)^(df-1) dphi

(substitute x = cos^2(phi) in the regularised incomplete beta I_x(df/2, 1/2)). Both integrals
are evaluated with composite Simpson's rule over a fixed grid, written with the higher-order
functions ``sequence`` + ``aggregate`` so the work stays inside the JVM. The integrand decays
like exp(-(df-1)(tan(theta) d + d^2/2)) away from the lower limit, so each integral is cut
where it has fallen below e^-40 of its start; the grid then always resolves it, for any df.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 97.5 % standard-normal quantile used by cor.test's 95 % interval, and the
# significance level quoted in the analysed code's interpretation text.
Z_975 = 1.959963984540054
DEFAULT_ALPHA = 0.005

SIMPSON_INTERVALS = 4096
DECAY_EXPONENT = 40.0


def _simpson_cos_power(start: Column, width: Column, power: Column,
                       intervals: int = SIMPSON_INTERVALS) -> Column:
    """Simpson's rule for the integral of cos(phi)^power over [start, start + width]."""
    h = width / F.lit(float(intervals))

    def step(acc: Column, i: Column) -> Column:
        weight = (F.when((i == 0) | (i == intervals), F.lit(1.0))
                  .when(i % 2 == 1, F.lit(4.0))
                  .otherwise(F.lit(2.0)))
        # cos(phi)^m = exp(m/2 * log1p(-sin(phi)^2)): exact near phi = 0, where cos(phi) is
        # within an ulp of 1 and a plain power would lose all precision for large m.
        s2 = F.pow(F.sin(start + i.cast("double") * h), 2)
        value = (F.when(power == 0, F.lit(1.0))
                 .when(s2 >= 1, F.lit(0.0))
                 .otherwise(F.exp(power / 2 * F.log1p(-s2))))
        return acc + weight * value

    total = F.aggregate(F.sequence(F.lit(0), F.lit(intervals)), F.lit(0.0), step)
    return total * h / F.lit(3.0)


def t_two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided Student-t tail probability P(|T_df| > |t|); NULL unless df >= 1."""
    nu = df.cast("double")
    power = nu - F.lit(1.0)
    theta = F.atan(F.abs(t.cast("double")) / F.sqrt(nu))
    half_pi = F.lit(math.pi / 2)
    # least() skips NULLs: the decay bounds are NULL when power or tan(theta) is 0.
    gauss_width = F.sqrt(F.try_divide(F.lit(2 * DECAY_EXPONENT), power))
    exp_width = F.try_divide(F.lit(DECAY_EXPONENT), power * F.tan(theta))
    tail = _simpson_cos_power(theta, F.least(half_pi - theta, gauss_width, exp_width), power)
    whole = _simpson_cos_power(F.lit(0.0), F.least(half_pi, gauss_width), power)
    # least() would also skip a NULL ratio, so the NULL cases are excluded explicitly.
    return F.when((nu >= 1) & t.isNotNull(), F.least(F.lit(1.0), tail / whole))


def pearson_test_from_moments(moments: DataFrame, n: str, sxx: str, syy: str, sxy: str,
                              alpha: float = DEFAULT_ALPHA, digits: int | None = None) -> DataFrame:
    """Test outputs from the pair count and centred sums of squares / cross-products.

    Returns columns ``n, r, t, df, p_value, ci_low, ci_high, significant``. ``r`` is NULL for
    fewer than 3 pairs and for a constant column; ``t`` is NULL for |r| = 1 (p is then 0).
    The p-value is computed in its own projection and read by the next, so its integrals
    are evaluated once (Catalyst does not inline a costly expression used twice).
    """
    n_, sxx_, syy_, sxy_ = F.col(n), F.col(sxx), F.col(syy), F.col(sxy)
    r = F.when((n_ >= 3) & (sxx_ * syy_ > 0), sxy_ / F.sqrt(sxx_ * syy_))
    df = (n_ - F.lit(2)).cast("bigint")
    stage1 = moments.select(n_.cast("bigint").alias("n"), r.alias("r"), df.alias("_df"))
    perfect = F.abs(F.col("r")) >= 1.0
    t = F.when(~perfect, F.col("r") * F.sqrt(F.col("_df").cast("double") / (F.lit(1.0) - F.col("r") ** 2)))
    stage2 = stage1.select("*", t.alias("t"))
    p = F.when(perfect, F.lit(0.0)).otherwise(t_two_sided_p(F.col("t"), F.col("_df")))
    stage3 = stage2.select("*", p.alias("_p"))
    half = F.lit(Z_975) / F.sqrt((F.col("n") - F.lit(3)).cast("double"))
    ci_low = F.when(F.col("n") > 3, F.when(perfect, F.col("r")).otherwise(F.tanh(F.atanh(F.col("r")) - half)))
    ci_high = F.when(F.col("n") > 3, F.when(perfect, F.col("r")).otherwise(F.tanh(F.atanh(F.col("r")) + half)))

    def rnd(c: Column) -> Column:
        return F.round(c, digits) if digits is not None else c

    return stage3.select(
        "n",
        rnd(F.col("r")).alias("r"),
        rnd(F.col("t")).alias("t"),
        F.when(F.col("n") >= 3, F.col("_df")).alias("df"),
        rnd(F.col("_p")).alias("p_value"),
        rnd(ci_low).alias("ci_low"),
        rnd(ci_high).alias("ci_high"),
        (F.col("_p") < F.lit(alpha)).alias("significant"),
    )
