"""Ratios that are 0 instead of an error when there is nothing to divide by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(x: Column, y: Column, scale: float = 1.0) -> Column:
    return F.coalesce(F.try_divide(x.cast("double") * F.lit(scale), y.cast("double")), F.lit(0.0))


def harmonic(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def prf(tp: Column, predicted: Column, actual: Column) -> tuple[Column, Column, Column]:
    p = safe_ratio(tp, predicted)
    r = safe_ratio(tp, actual)
    return p, r, harmonic(p, r)
