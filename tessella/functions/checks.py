"""Checks of input values as Columns: a row that fails one ends the query with an error that names the value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(features: Column, what: str = "features") -> Column:
    """The vector as doubles; an error where it is null or empty, or where a number is null, NaN or infinite."""
    v = features.cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(F.coalesce(F.size(v) > 0, F.lit(False)) & ~F.coalesce(odd, F.lit(True)), v).otherwise(F.raise_error(F.concat(F.lit(f"{what} must be finite numbers: "), F.coalesce(F.to_json(v), F.lit("null")))))


def within(x: Column, low: float, high: float, what: str) -> Column:
    """The number as it is; an error where it is null, NaN or not from ``low`` to ``high``."""
    number = x.cast("double")
    fits = F.coalesce((number >= low) & (number <= high) & ~F.isnan(number), F.lit(False))
    return F.when(fits, x).otherwise(F.raise_error(F.concat(F.lit(f"{what} must be from {low} to {high}: "), F.coalesce(x.cast("string"), F.lit("null")))))


def settings(clusters: int, recency_window: int) -> None:
    """An error unless both are positive."""
    if clusters < 1:
        raise ValueError("there must be one cluster at least")
    if recency_window < 1:
        raise ValueError("the recency window must be one day at least")
