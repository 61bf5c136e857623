"""Interval, exact-test and quantile expressions, all as native Columns.

Nothing here runs Python on executors: every function takes Columns (or
numbers) and returns a Column that stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Normal quantiles the study uses for its usual alphas.
Z_TABLE = {0.10: 1.6449, 0.05: 1.96, 0.01: 2.5758}

# Coefficients of Acklam's rational approximation.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _dbl(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def _horner(coefficients, x: Column) -> Column:
    out = _dbl(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + _dbl(c)
    return out


def normal_quantile(p) -> Column:
    """Inverse normal CDF for p in (0, 1); null outside."""
    p = _dbl(p)
    low = 0.02425
    tail = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail_value = _horner(ACKLAM_C, tail) / (_horner(ACKLAM_D, tail) * tail + 1)
    q = p - 0.5
    r = q * q
    centre = _horner(ACKLAM_A, r) * q / (_horner(ACKLAM_B, r) * r + 1)
    return F.when((p > 0) & (p < low), tail_value).when((p >= low) & (p <= 1 - low), centre).when((p > 1 - low) & (p < 1), -tail_value)


def z_for(alpha: float) -> Column:
    """Two-sided critical value: the table where it has one, else the quantile."""
    return _dbl(Z_TABLE[alpha]) if alpha in Z_TABLE else normal_quantile(1 - alpha / 2)


def wilson(successes: Column, n: Column, alpha: float = 0.05) -> Column:
    """struct(point, low, high); zeros where n <= 0, clamped to [0, 1]."""
    z, n_, k = z_for(alpha), _dbl(n), _dbl(successes)
    safe = F.greatest(n_, _dbl(1))
    p = k / safe
    denominator = 1 + z * z / safe
    centre = (p + z * z / (2 * safe)) / denominator
    half = z / denominator * F.sqrt(F.greatest(p * (1 - p) / safe + z * z / (4 * safe * safe), _dbl(0)))
    zero = _dbl(0)
    some = n_ > 0
    return F.struct(
        F.when(some, p).otherwise(zero).alias("point"),
        F.when(some, F.greatest(zero, centre - half)).otherwise(zero).alias("low"),
        F.when(some, F.least(_dbl(1), centre + half)).otherwise(zero).alias("high"),
    )


def log_gamma(x: Column) -> Column:
    """ln(gamma(x)) for x >= 1 by Stirling's series, shifted up by 8 (error under 1e-13)."""
    x = _dbl(x)
    y = x + 8
    shift = F.log(x)
    for i in range(1, 8):
        shift = shift + F.log(x + i)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, _dbl(5))) - 1 / (1680 * F.pow(y, _dbl(7)))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - shift


def binomial_tail(k: Column, n: Column, p: float = 0.5) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exact to rounding.

    The largest term is taken from log-gamma, the others by their ratio, going
    down from k; terms below 1e-18 of the largest are beyond double precision,
    so at most ~60 standard deviations are visited however large n is.
    k < 0 gives 0, k >= n gives 1; only meaningful for k <= n*p.
    """
    k_, n_ = _dbl(k), _dbl(n)
    log_top = log_gamma(n_ + 1) - log_gamma(k_ + 1) - log_gamma(n_ - k_ + 1) + k_ * F.log(_dbl(p)) + (n_ - k_) * F.log(_dbl(1 - p))
    reach = F.least(k_, F.ceil(60 * F.sqrt(n_ * p * (1 - p)) + 60).cast("double")).cast("int")
    odds = (1 - p) / p
    total = F.aggregate(
        F.sequence(F.lit(0), F.greatest(reach, F.lit(0))),
        F.struct(_dbl(1).alias("term"), _dbl(0).alias("sum")),
        lambda acc, i: F.struct(
            (acc["term"] * (k_ - i) / (n_ - k_ + i + 1) * odds).alias("term"),
            (acc["sum"] + acc["term"]).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return F.when(k_ < 0, _dbl(0)).when(k_ >= n_, _dbl(1)).otherwise(F.least(_dbl(1), F.exp(log_top) * total))


def binomial_two_sided(k: Column, n: Column) -> Column:
    """Exact two-sided p-value at p = 0.5: twice the smaller tail, at most 1; 1 where n <= 0."""
    small = F.least(k, n - k)
    return F.when(n <= 0, _dbl(1)).otherwise(F.least(_dbl(1), 2 * binomial_tail(small, n)))


def sign_test_one_sided(wins: Column, n: Column) -> Column:
    """P(X >= wins) at p = 0.5."""
    losses = n - wins
    upper = F.when(losses <= wins, binomial_tail(losses, n)).otherwise(1 - binomial_tail(wins - 1, n))
    return F.when(n <= 0, _dbl(1)).otherwise(upper)


def mcnemar_exact(only_base: Column, only_final: Column) -> Column:
    return binomial_two_sided(only_final, only_base + only_final)


def classify_interval(low: Column, high: Column) -> Column:
    return F.when(low > 0, "gain").when(high < 0, "regression").otherwise("no_effect")


def excludes_zero(low: Column, high: Column) -> Column:
    return (low > 0) | (high < 0)


def normalise_score(raw: Column) -> Column:
    """1-5 to 0-100."""
    return (raw - 1) / 4 * 100
