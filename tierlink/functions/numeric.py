"""Numeric, array and vector expressions (numerically stable forms)."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def is_close(a: Column, b: Column) -> Column:
    """|a - b| <= 1e-8 + 1e-5 |b|."""
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def clamp_log(x: Column, eps: float = 1e-12) -> Column:
    return F.ln(F.greatest(x, F.lit(eps)))


def softmax(df, x: str, keys: list[str], out: str, eps: float = 1e-12):
    """exp(x - max) / (sum + eps) within each group of ``keys``, as column ``out``."""
    group = Window.partitionBy(*keys)
    shifted = df.withColumn("__e", F.exp(F.col(x) - F.max(x).over(group)))
    return shifted.withColumn(out, F.col("__e") / (F.sum("__e").over(group) + eps)).drop("__e")


def min_max(x: Column, over: WindowSpec, constant: float, with_zero: Column | None = None) -> Column:
    """(x - min) / (max - min) in the group; ``constant`` where all are close.

    ``with_zero``: groups where it is true for a row are scaled as if they held a 0 too.
    """
    lo, hi = F.min(x).over(over), F.max(x).over(over)
    if with_zero is not None:
        has = F.max(with_zero).over(over)
        lo, hi = F.when(has, F.least(lo, F.lit(0.0))).otherwise(lo), F.when(has, F.greatest(hi, F.lit(0.0))).otherwise(hi)
    return F.when(is_close(hi, lo), F.lit(constant)).otherwise((x - lo) / (hi - lo))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def fit_dim(v: Column, size: int) -> Column:
    """A vector cut or zero-padded to ``size``."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), size)), 1, size)
