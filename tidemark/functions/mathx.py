"""Column expressions Spark has no built-in for: erf, normal law, gamma, great-circle distance."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the Abramowitz & Stegun 7.1.26 error-function formula.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

# Lanczos coefficients (g = 7, n = 9) of the gamma function.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
           -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6,
           1.5056327351493116e-7)

# Acklam's rational approximation of the normal quantile.
ACK_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
         -3.066479806614716e+01, 2.506628277459239e+00)
ACK_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
         -1.328068155288572e+01)
ACK_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
         4.374664141464968e+00, 2.938163982698783e+00)
ACK_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)


def _poly(x: Column, coef) -> Column:
    out = F.lit(coef[0])
    for c in coef[1:]:
        out = out * x + F.lit(c)
    return out


def erf(x: Column) -> Column:
    """Error function, absolute error below 1.5e-7."""
    a = F.abs(x)
    t = 1.0 / (1.0 + ERF_P * a)
    y = 1.0 - _poly(t, tuple(reversed(ERF_A))) * t * F.exp(-a * a)
    return F.signum(x) * y


def norm_cdf(z: Column) -> Column:
    return 0.5 * (1.0 + erf(z / math.sqrt(2.0)))


def norm_ppf(p: Column) -> Column:
    low = F.sqrt(-2.0 * F.log(p))
    high = F.sqrt(-2.0 * F.log(1.0 - p))
    mid = p - 0.5
    r = mid * mid
    centre = _poly(r, ACK_A) * mid / (_poly(r, ACK_B) * r + 1.0)
    tail = lambda q: _poly(q, ACK_C) / (_poly(q, ACK_D) * q + 1.0)
    return F.when(p < 0.02425, tail(low)).when(p > 1 - 0.02425, -tail(high)).otherwise(centre)


def gamma(x: Column) -> Column:
    """Gamma function for x > 0.5."""
    z = x - 1.0
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        total = total + F.lit(c) / (z + float(i))
    t = z + 7.5
    return math.sqrt(2 * math.pi) * F.pow(t, z + 0.5) * F.exp(-t) * total


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of radius 6371 km."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.sin((p2 - p1) / 2) ** 2 + F.cos(p1) * F.cos(p2) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * F.asin(F.sqrt(h))
