"""Small Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_A_DAY = 86_400


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def ratio(top: Column, bottom: Column, otherwise: float | None = 0.0) -> Column:
    """``top / bottom``, or ``otherwise`` where the divisor is zero or null."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(otherwise))


def trunc(x: Column, kind: str = "bigint") -> Column:
    """Towards zero."""
    return x.cast(kind)


def bands(x: Column, steps: list[tuple[str, float, object]], otherwise: object) -> Column:
    """The value of the first step whose comparison holds: ('<', limit, value)."""
    compare = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
    out = None
    for sign, limit, value in steps:
        holds = compare[sign](x, F.lit(limit))
        out = F.when(holds, F.lit(value)) if out is None else out.when(holds, F.lit(value))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def whole_days(seconds: Column) -> Column:
    """Whole 24-hour periods, towards zero."""
    return (seconds / SECONDS_A_DAY).cast("bigint")


def epoch(ts: Column) -> Column:
    """Epoch seconds of a timestamp with or without zone; the session must be on UTC."""
    return F.unix_timestamp(ts.cast("timestamp"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
