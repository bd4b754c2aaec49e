"""Python-compatible rounding as a Column expression.

Python's ``round(x, d)`` rounds the exact binary value of ``x`` half-even.
Scaling by ``10**d`` in floating point can land exactly on ``k + 0.5`` even
when the exact product is not a tie (2.675 * 100 == 267.5), so the product's
rounding error is recovered exactly with Dekker's two-product (Veltkamp
split; all plain double arithmetic, which Spark never re-associates) and
used to break such ties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1


def py_round(x: Column, decimals: int = 2) -> Column:
    scale = float(10 ** decimals)            # exact, <= 27 significant bits
    x = x.cast("double")
    p = x * F.lit(scale)
    t = x * F.lit(_SPLIT)
    hi = t - (t - x)
    lo = x - hi
    err = (hi * F.lit(scale) - p) + lo * F.lit(scale)   # exactly x*scale - p
    k = F.floor(p).cast("double")
    frac = p - k
    up = (F.when(frac > 0.5, F.lit(True))
           .when(frac < 0.5, F.lit(False))
           .when(err > 0, F.lit(True))
           .when(err < 0, F.lit(False))
           .otherwise(F.pmod(k, F.lit(2.0)) != 0))
    r = F.when(up, k + F.lit(1.0)).otherwise(k)
    return F.when(x.isNull() | F.isnan(x), x).otherwise(r / F.lit(scale))
