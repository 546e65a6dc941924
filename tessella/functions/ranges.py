"""Running sums over ordered rows that no single task has to order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.scratch import written


def same_keys(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Inner join on keys that may be null; the right side has one row per key, and with no keys one row."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    named = {c: f"_key_{c}" for c in by}
    right = right.withColumnsRenamed(named)
    return left.join(right, reduce(Column.__and__, [left[c].eqNullSafe(right[n]) for c, n in named.items()])).drop(*named.values())


def cumulative(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds, for each ``out: column`` of ``sums``, the sum of the column up to and with the row, in the order, per key.

    The rows are dealt by range of key and order and written once; a task then
    orders one range of one key, and what comes before it is a sum of one row
    per range. Keys may be null. Rows that tie in the order should be one row.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(n, *[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({f"_in_{out}": F.sum(c).over(inside) for out, c in sums.items()})
    per = dealt.groupBy("_range", *by).agg(*[F.sum(c).alias(f"_sum_{out}") for out, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*[F.col(c).alias(f"_of_{c}") for c in ("_range", *by)], *[F.coalesce(F.sum(f"_sum_{out}").over(before), F.lit(0)).alias(f"_before_{out}") for out in sums])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by], F.col("_range") == F.col("_of__range"))
    return local.join(per, same).select(*rows.columns, *[(F.col(f"_in_{out}") + F.col(f"_before_{out}")).alias(out) for out in sums])


def totals(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Per key: ``n`` rows and, for each ``out: column`` of ``sums``, the sum of the column, its numbers added one by one in the order.

    The last bits of a sum of doubles hang on the order, and a figure that lies
    on a limit or on a half hangs on them; so these sums don't depend on how
    the rows are dealt. One task walks a key's rows, which may spill.
    """
    so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    walked = rows.select(*by, F.struct(F.count("*").over(so_far).alias("n"), *[F.sum(c).over(so_far).alias(out) for out, c in sums.items()]).alias("_sums"))
    return walked.groupBy(*by).agg(F.max_by("_sums", "_sums.n").alias("_sums")).select(*by, "_sums.*")


def preceding(rows: DataFrame, by: list[str], order: str, values: dict[str, str]) -> DataFrame:
    """Adds, for each ``out: column`` of ``values``, the column's value on the row before, in the order, per key; null on the first.

    Dealt as in ``cumulative``: a range's first row of a key takes the last of
    the ranges before it, of which there is one row per range and key.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(n, *by, order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range", *by).orderBy(order)
    local = dealt.withColumn("_in", F.lag(F.struct(*values.values())).over(inside))
    per = dealt.groupBy("_range", *by).agg(F.max_by(F.struct(*values.values()), order).alias("_last"))
    per = per.select(*[F.col(c).alias(f"_of_{c}") for c in ("_range", *by)], F.lag("_last").over(Window.partitionBy(*by).orderBy("_range")).alias("_before"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by], F.col("_range") == F.col("_of__range"))
    found = local.join(per, same).withColumn("_in", F.coalesce("_in", "_before"))
    return found.select(*rows.columns, *[F.col("_in")[c].alias(out) for out, c in values.items()])


def quarters(values: DataFrame, by: list[str]) -> DataFrame:
    """Per key of rows with ``x``: n, median, p25, p75. Null values don't count.

    The quarter values are the elements at places ⌊n/4⌋ and ⌊3n/4⌋ of the
    sorted values; the median is the mean of the middle two. Values are counted
    first, so that no task orders all values of a key.
    """
    counted = values.where("x IS NOT NULL").groupBy(*by, "x").agg(F.count("*").alias("_k"))
    at = cumulative(counted, by, [F.col("x").asc()], {"_upto": "_k"})
    at = same_keys(at, at.groupBy(*by).agg(F.max("_upto").alias("_n")), by)
    element = lambda i: F.max(F.when((F.col("_upto") - F.col("_k") <= i) & (i < F.col("_upto")), F.col("x")))
    place = lambda q: F.least(F.floor(F.col("_n") * q), F.col("_n") - 1)
    middle = (element(F.floor((F.col("_n") - 1) / 2)) + element(F.floor(F.col("_n") / 2))) / 2.0
    return at.groupBy(*by).agg(F.max("_n").alias("n"), middle.alias("median"), element(place(0.25)).alias("p25"), element(place(0.75)).alias("p75"))
