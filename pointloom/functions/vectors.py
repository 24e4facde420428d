"""Column expressions over array vectors; all stay within the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product; null if a length differs."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def squared_distance(a: str | Column, b: str | Column) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def distance(a: str | Column, b: str | Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(squared_distance(a, b))


def vector(values: Sequence[float]) -> Column:
    """A literal vector."""
    return F.array(*[F.lit(float(v)) for v in values])


def total(x: str | Column) -> Column:
    """Sum of the entries."""
    return F.aggregate(_c(x), F.lit(0.0), lambda s, v: s + v)


def mean_vector(x: str, d: int) -> Column:
    """Entry-wise mean of a group's vectors as `d` partial aggregates."""
    return F.array(*[F.avg(F.col(x)[i]) for i in range(d)])


def project(x: str | Column, matrix: Sequence[Sequence[float]]) -> Column:
    """`x` times a matrix given by columns."""
    return F.array(*[dot(x, vector(column)) for column in matrix])


def ts_statistics(x: str) -> dict[str, Column]:
    """Eight statistics of a series: mean, deviation, extremes, range, skewness, excess kurtosis, mean absolute deviation.

    Where the variance is 1e-12 or less, 1 stands for the deviation in the shape measures.
    """
    n = F.size(x).cast("double")
    mean = total(x) / n
    power = lambda p: F.aggregate(F.transform(x, lambda v: F.pow(v - F.col("__pl_mean"), F.lit(p))), F.lit(0.0), lambda s, v: s + v) / n
    sd = F.when(F.col("__pl_var") > 1e-12, F.sqrt("__pl_var")).otherwise(1.0)
    return {
        "__pl_mean": mean,
        "__pl_var": power(2.0),
        "mean": F.col("__pl_mean"),
        "std": F.sqrt("__pl_var"),
        "min": F.array_min(x),
        "max": F.array_max(x),
        "range": F.array_max(x) - F.array_min(x),
        "skew": power(3.0) / F.pow(sd, F.lit(3.0)),
        "kurtosis": F.when(F.col("__pl_var") > 1e-12, power(4.0) / F.pow(sd, F.lit(4.0)) - 3.0).otherwise(power(4.0) - 3.0),
        "mad": F.aggregate(F.transform(x, lambda v: F.abs(v - F.col("__pl_mean"))), F.lit(0.0), lambda s, v: s + v) / n,
    }


def autocorrelation(x: str, lag: int) -> Column:
    """Correlation of the centred series with itself `lag` later; 0 where the series is too short or flat."""
    centred = F.transform(x, lambda v: v - F.col("__pl_mean"))
    n = F.size(x)
    a = F.slice(centred, 1, F.greatest(n - lag, F.lit(0)))
    b = F.slice(centred, lag + 1, F.greatest(n - lag, F.lit(0)))
    norm = F.sqrt(dot(a, a) / (n - lag)) * F.sqrt(dot(b, b) / (n - lag))
    return F.when(n <= lag, 0.0).when(norm <= 1e-12, 0.0).otherwise(dot(a, b) / (n - lag) / norm)


def detrended(x: str) -> Column:
    """The series less its least-squares line."""
    n = F.size(x).cast("double")
    t_mean = (n - 1) / 2
    num = F.aggregate(F.transform(x, lambda v, i: (i - t_mean) * v), F.lit(0.0), lambda s, v: s + v)
    den = n * (n * n - 1) / 12
    slope = F.when(den > 0, num / den).otherwise(0.0)
    return F.transform(x, lambda v, i: v - F.col("__pl_mean") - slope * (i - t_mean))


def fourier_magnitude(x: str, k: int) -> Column:
    """Magnitude of bin `k` of the discrete Fourier transform; 0 beyond the last bin."""
    n = F.size(x).cast("double")
    turn = lambda i: F.lit(2.0 * 3.141592653589793 * k) * i / n
    re = F.aggregate(F.transform(x, lambda v, i: v * F.cos(turn(i))), F.lit(0.0), lambda s, v: s + v)
    im = F.aggregate(F.transform(x, lambda v, i: v * F.sin(turn(i))), F.lit(0.0), lambda s, v: s + v)
    return F.when(k <= F.floor(n / 2), F.sqrt(re * re + im * im)).otherwise(0.0)


def nan_to_num(x: str | Column, fill: float = 0.0) -> Column:
    """A vector with NaN, infinities and nulls as `fill`."""
    inf = float("inf")
    return F.transform(x, lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == inf), F.lit(fill)).otherwise(v))
