"""Recency, frequency and monetary value of customers; scores and labels.

Scoring a dimension needs the global position of each customer. ``positions``
gets it from a range partitioning, per-partition counts and a local rank, so no
task ever sees more than one range of customers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import clamp, epoch, whole_days
from tessella.sources.scratch import written

SCORE_TOP = {"quintile": 5, "decile": 10, "percentile": 100}
#: Customers up to which one task orders them all, as dealing them out costs more than it saves.
ONE_TASK = 100_000


def base(tx: DataFrame, as_of: str) -> DataFrame:
    """One row per customer: recency in whole days, frequency, monetary.

    Rows without a date count for nothing, but their customer still appears
    with zeros.
    """
    dated = F.col("ts").isNotNull()
    latest = F.max(epoch(F.col("ts")))
    return tx.groupBy("customer_id").agg(
        F.coalesce(whole_days(F.lit(as_of).cast("timestamp").cast("bigint") - latest).cast("double"), F.lit(0.0)).alias("recency"),
        F.count(F.when(dated, 1)).cast("double").alias("frequency"),
        F.coalesce(F.sum(F.when(dated, F.col("amount"))), F.lit(0.0)).alias("monetary"),
    )


def decay(days: Column, kind: str, half_life: int = 30) -> Column:
    """Recency weight: linear over three half lives, exponential, or inverse."""
    if kind == "linear":
        return clamp((3.0 * half_life - days) / (3.0 * half_life), 0.0, 1.0)
    if kind == "exponential":
        return F.least(F.pow(F.lit(2.0), -days / half_life), F.lit(1.0))
    if kind == "inverse":
        return F.lit(1.0) / (1.0 + days / half_life)
    raise ValueError(f"unknown decay {kind}")


def positions(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """0-based position of each row in the order, without a one-task window.

    The rows are dealt by range and written once, so that both the sizes of
    the ranges and the rows in them come from the same deal; the offsets are
    one row per range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "positions")
    local = dealt.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return local.join(before, "_part").withColumn(out, (F.col("_local") + F.col("_before")).cast("bigint")).drop("_part", "_local", "_before")


def score(position: Column, n: Column, method: str, orientation: str = "reference") -> Column:
    """Score of a 0-based descending position among ``n`` customers.

    By quintile or decile the largest value gets 1; ``high_is_best`` turns
    that round. By percentile the largest value gets 100 either way.
    """
    top = SCORE_TOP[method]
    p = position / n
    raw = ((1.0 - p) * 100.0).cast("int") if method == "percentile" else F.ceil(top * p).cast("int")
    bounded = F.least(F.greatest(raw, F.lit(1)), F.lit(top))
    return F.lit(top + 1) - bounded if orientation == "high_is_best" and method != "percentile" else bounded


def scored(frame: DataFrame, method: str = "quintile", orientation: str = "reference") -> DataFrame:
    """Scores for recency, frequency and monetary, each in descending order of value.

    Ties keep the order of the dimension scored before, and in the end the
    customer id, as repeated stable sorts would.
    """
    frame = written(frame, "customers")
    n = frame.count()
    r = [F.col("recency").desc(), F.col("customer_id").asc()]
    f = [F.col("frequency").desc(), *r]
    m = [F.col("monetary").desc(), *f]
    out = frame
    for order, name in ((r, "_r"), (f, "_f"), (m, "_m")):
        out = out.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1) if n <= ONE_TASK else positions(out, order, name)
    for name, to in (("_r", "recency_score"), ("_f", "frequency_score"), ("_m", "monetary_score")):
        out = out.withColumn(to, score(F.col(name), F.lit(n), method, orientation))
    return out.drop("_r", "_f", "_m")


def segment8(r: Column, f: Column, m: Column) -> Column:
    """Eight labels from whether each score is 4 or more."""
    hi = lambda c: c >= 4
    return (
        F.when(hi(r) & hi(f) & hi(m), "Champions")
        .when(hi(r) & hi(f), "Loyal Customers")
        .when(hi(r) & hi(m), "Potential Loyalists")
        .when(hi(r), "At Risk")
        .when(hi(f) & hi(m), "VIP")
        .when(hi(f), "Need Attention")
        .when(hi(m), "Promising")
        .otherwise("Lost")
    )


def rank_text(r: Column, f: Column, m: Column) -> Column:
    return F.concat(r.cast("string"), f.cast("string"), m.cast("string"))


def normalized(frame: DataFrame, columns: tuple[str, ...] = ("recency", "frequency", "monetary")) -> DataFrame:
    """Min-max scaled columns; 0.5 where all values agree."""
    ends = frame.agg(*[g(c).alias(f"_{k}_{c}") for c in columns for k, g in (("lo", F.min), ("hi", F.max))])
    out = frame.crossJoin(F.broadcast(ends))  # one row
    for c in columns:
        width = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        out = out.withColumn(c, F.when(width > 0, (F.col(c) - F.col(f"_lo_{c}")) / width).otherwise(F.lit(0.5)))
    return out.drop(*[f"_{k}_{c}" for c in columns for k in ("lo", "hi")])
