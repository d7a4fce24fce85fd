"""Statistics of proportions and the normal distribution as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.96


# The rational approximations of erf and erfc by Cody (1969), highest power last.
_ERF = ([3209.37758913846947, 377.485237685302021, 113.864154151050156, 3.16112374387056560, 0.185777706184603153], [2844.23683343917062, 1282.61652607737228, 244.024637934444173, 23.6012909523441209, 1.0])
_ERFC = (
    [1230.33935479799725, 2051.07837782607147, 1712.04761263407058, 881.952221241769090, 298.635138197400131, 66.1191906371416295, 8.88314979438837594, 0.564188496988670089, 2.15311535474403846e-8],
    [1230.33935480374942, 3439.36767414372164, 4362.61909014324716, 3290.79923573345963, 1621.38957456669019, 537.181101862009858, 117.693950891312499, 15.7449261107098347, 1.0],
)
_TAIL = (
    [6.58749161529837803e-4, 1.60837851487422766e-2, 1.25781726111229246e-1, 3.60344899949804439e-1, 3.05326634961232344e-1, 1.63153871373020978e-2],
    [2.33520497626869185e-3, 6.05183413124413191e-2, 5.27905102951428412e-1, 1.87295284992346725, 2.56852019228982242, 1.0],
)


def _ratio(x: Column, polynomials: tuple[list[float], list[float]]) -> Column:
    def horner(c: list[float]) -> Column:
        out = F.lit(c[-1])
        for k in reversed(c[:-1]):
            out = out * x + k
        return out

    return horner(polynomials[0]) / horner(polynomials[1])


def erfc(x: Column) -> Column:
    """The complementary error function, to about 15 digits, in generated code; missing stays missing."""
    a = F.abs(x)
    square = F.exp(-a * a)
    far = 1 / (a * a)
    beyond = square / a * (1 / math.sqrt(math.pi) - far * _ratio(far, _TAIL))
    upper = F.when(a <= 4, square * _ratio(a, _ERFC)).when(a < 27, beyond).otherwise(0.0)
    return F.when(F.isnan(x), None).when(a <= 0.46875, 1 - x * _ratio(x * x, _ERF)).otherwise(F.when(x < 0, 2 - upper).otherwise(upper))


def two_sided_p(z: Column) -> Column:
    """2 (1 - Phi(|z|)) = erfc(|z| / sqrt 2); missing stays missing."""
    return erfc(F.abs(z) / math.sqrt(2))


def norm_cdf(x: Column) -> Column:
    return 0.5 * erfc(-x / math.sqrt(2))


def z_score(k: Column, n: Column, p0: Column) -> Column:
    """Of k in n against p0; null without trials, 0 where p0 leaves no variance."""
    se = F.sqrt(p0 * (1 - p0) / F.nullif(n, F.lit(0)))
    return F.when(se == 0, F.lit(0.0)).otherwise((k / F.nullif(n, F.lit(0)) - p0) / F.nullif(se, F.lit(0.0)))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Low and high end of the score interval."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    d = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def adjust_p(df: DataFrame, p: str, out: str = "p_adj", method: str = "fdr_bh", keys: tuple[str, ...] = ()) -> DataFrame:
    """Multiple-test adjustment over all rows with a p-value (of each key, if any are given).

    Without keys the tests of a whole run are pooled, which is one row for each condition and
    horizon: a table of results, not of bars. fdr_bh, fdr_by and bonferroni."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    has = F.col(p).isNotNull()
    df = df.withColumn("_m", F.count(p).over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.col(p).asc_nulls_last())))
    if method == "bonferroni":
        adjusted = F.least(F.lit(1.0), F.col(p) * F.col("_m"))
    else:
        harmonic = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("_m"), F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / i) if method == "fdr_by" else F.lit(1.0)
        if method not in ("fdr_bh", "fdr_by"):
            raise ValueError(f"unknown method {method!r}")
        raw = F.when(has, F.least(F.lit(1.0), F.col(p) * F.col("_m") * harmonic / F.col("_r")))
        adjusted = F.min(raw).over(w.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.when(has, adjusted)).drop("_m", "_r")


def bootstrap_ci(values: np.ndarray, n: int, level: float, seed: int | None) -> tuple[float | None, float | None]:
    """Percentile interval of the mean."""
    values = values[np.isfinite(values)]
    if len(values) < 2 or n <= 0:
        return None, None
    rng = np.random.default_rng(seed)
    means = np.array([rng.choice(values, size=len(values), replace=True).mean() for _ in range(n)])
    low, high = np.percentile(means, [50 * (1 - level), 50 * (1 + level)])
    return float(low), float(high)
