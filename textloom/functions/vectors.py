"""Column expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null or zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def kernel_means(n: int) -> list[float]:
    """Centres of n Gaussian kernels over [-1, 1]: one for exact matches at 1, the others mid-bin."""
    if n == 1:
        return [1.0]
    width = 2.0 / (n - 1)
    return [1.0] + [1.0 - width / 2 - width * i for i in range(n - 1)]


def kernel_widths(n: int) -> list[float]:
    return [1e-4] if n == 1 else [1e-4] + [1.0 / (n - 1)] * (n - 1)


def argmax(a: Column) -> Column:
    """Position from 0 of the first greatest value."""
    return F.array_position(a, F.array_max(a)).cast("int") - 1
