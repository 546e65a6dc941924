"""Distribution statistics, two-sample drift and composition change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.columns import bands, ratio
from tessella.functions.gamma import upper_gamma
from tessella.functions.names import known
from tessella.functions.ranges import cumulative, quarters, same_keys

SEVERITIES = ("none", "low", "medium", "high", "critical")


def severity(score: Column) -> Column:
    return bands(score, [("<", 0.1, "none"), ("<", 0.2, "low"), ("<", 0.35, "medium"), ("<", 0.5, "high")], "critical")


def severity_rank(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), name).cast("int") - 1


def statistics(values: DataFrame, by: list[str]) -> DataFrame:
    """Moments and quartiles of ``x`` per key.

    The quarter values are elements of the sorted values, not interpolated;
    the median is. Skewness and excess kurtosis are 0 for constant values.
    """
    moments = values.where("x IS NOT NULL").groupBy(*by).agg(
        F.avg("x").alias("mean"),
        F.stddev_pop("x").alias("std_dev"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.coalesce(F.skewness("x"), F.lit(0.0)).alias("skewness"),
        F.coalesce(F.kurtosis("x"), F.lit(0.0)).alias("kurtosis"),
    )
    return same_keys(moments, quarters(values, by), by).select(*by, "mean", "std_dev", "min", "max", "median", "p25", "p75", "skewness", "kurtosis")


def kolmogorov_smirnov(samples: DataFrame, by: list[str]) -> DataFrame:
    """Two-sample statistic of (side 0 or 1, x) per key; 0 where a side is empty.

    Values are counted first; the running sums are over distinct values.
    """
    counted = samples.groupBy(*by, "x").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    at = cumulative(counted, by, [F.col("x").asc()], {"ca": "a", "cb": "b"})
    at = same_keys(at, at.groupBy(*by).agg(F.max("ca").alias("na"), F.max("cb").alias("nb")), by)
    gap = F.when((F.col("na") > 0) & (F.col("nb") > 0), F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).otherwise(0.0)
    return at.groupBy(*by).agg(F.max(gap).alias("drift_score"))


def hellinger(samples: DataFrame, by: list[str]) -> DataFrame:
    """Distance of normal fits of the two sides; variances are 1e-9 at least."""
    side = lambda f, k: f(F.when(F.col("side") == k, F.col("x")))
    m = samples.groupBy(*by).agg(side(F.avg, 0).alias("m0"), side(F.avg, 1).alias("m1"), F.greatest(side(F.var_pop, 0), F.lit(1e-9)).alias("v0"), F.greatest(side(F.var_pop, 1), F.lit(1e-9)).alias("v1"))
    v = F.col("v0") + F.col("v1")
    d = (F.col("m0") - F.col("m1")) * (F.col("m0") - F.col("m1")) / (4.0 * v) + 0.5 * F.log(v / (2.0 * F.sqrt(F.col("v0") * F.col("v1"))))
    return m.select(*by, F.coalesce(F.least(F.sqrt(F.greatest(1.0 - F.exp(-d), F.lit(0.0))), F.lit(1.0)), F.lit(0.0)).alias("drift_score"))


def chi_square(samples: DataFrame, by: list[str]) -> DataFrame:
    """Mean over the baseline's categories of (observed - expected)^2 / expected, for (side, category)."""
    per = samples.groupBy(*by, "category").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    total = per.groupBy(*by).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    at = per.join(total, by).where("a > 0")
    expected = F.col("a") / F.col("na") * F.col("nb")
    return at.groupBy(*by).agg(F.avg(F.when(expected > 0, (F.col("b") - expected) * (F.col("b") - expected) / expected)).alias("drift_score"))


def binned(samples: DataFrame, by: list[str], bins: int) -> DataFrame:
    """Per key and bin: how many values of side 0 and of side 1 fall in it, as ``a`` and ``b``.

    Bins have equal shares of side 0: edge i is the element at place ⌊n·i/bins⌋
    of its sorted values, and a value's bin is how many edges are at or below
    it. Bins that ties leave without values of either side are no rows. Values
    are counted first and ordered by ranges; a key's edges are fewer than
    ``bins`` numbers. Null values, and keys without side 0, have no bin.
    """
    counted = samples.where("x IS NOT NULL").groupBy(*by, "x").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    at = cumulative(counted.where("a > 0"), by, [F.col("x").asc()], {"_upto": "a"})
    at = same_keys(at, at.groupBy(*by).agg(F.max("_upto").alias("_n")), by)
    places = F.array(*[F.floor(F.col("_n") * i / bins) for i in range(1, bins)])
    holds = F.exists(places, lambda i: (F.col("_upto") - F.col("a") <= i) & (i < F.col("_upto")))
    edges = at.groupBy(*by).agg(F.array_sort(F.collect_set(F.when(holds, F.col("x")))).alias("_edges"))
    placed = same_keys(counted, edges, by).withColumn("bin", F.size(F.filter("_edges", lambda e: e <= F.col("x"))))
    return placed.groupBy(*by, "bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def kullback_leibler(samples: DataFrame, by: list[str], bins: int = 10, smoothing: float = 0.5) -> DataFrame:
    """Divergence of side 0 from side 1 over equal-frequency bins, each count raised by ``smoothing``.

    ``drift_score`` is √(1 − e^−divergence), which bounds the total variation
    distance from above; 0 where a side is empty.
    """
    per = binned(samples, by, bins)
    total = per.groupBy(*by).agg(F.sum("a").alias("_na"), F.sum("b").alias("_nb"), F.count("*").alias("_k"))
    at = same_keys(per, total, by)
    share = lambda c, n: (F.col(c) + smoothing) / (F.col(n) + smoothing * F.col("_k"))
    divergence = F.when((F.first("_na") > 0) & (F.first("_nb") > 0), F.greatest(F.sum(share("a", "_na") * F.log(share("a", "_na") / share("b", "_nb"))), F.lit(0.0))).otherwise(0.0)
    return at.groupBy(*by).agg(divergence.alias("divergence")).withColumn("drift_score", F.sqrt(1.0 - F.exp(-F.col("divergence"))))


def chi_square_numbers(samples: DataFrame, by: list[str], bins: int = 11) -> DataFrame:
    """Two-sample chi-square test over equal-frequency bins: statistic, p_value, and drift_score, which is Cramér's V.

    The degrees of freedom are the bins that have values, less one. Where a
    side is empty, or all values are in one bin, statistic and score are 0 and p_value is 1.
    """
    per = binned(samples, by, bins)
    total = per.groupBy(*by).agg(F.sum("a").alias("_na"), F.sum("b").alias("_nb"), F.count("*").alias("_k"))
    at = same_keys(per, total, by)
    n, row = F.col("_na") + F.col("_nb"), F.col("a") + F.col("b")
    gap = lambda c, side: (F.col(c) - row * F.col(side) / n) * (F.col(c) - row * F.col(side) / n) / (row * F.col(side) / n)
    usable = (F.col("_na") > 0) & (F.col("_nb") > 0)
    found = at.groupBy(*by).agg(F.sum(F.when(usable, gap("a", "_na") + gap("b", "_nb")).otherwise(0.0)).alias("statistic"), F.first("_k").alias("_k"), F.first(n).alias("_all"))
    p = F.lit(1.0)
    for k in range(2, bins + 1):
        p = F.when(F.col("_k") == k, upper_gamma((k - 1) / 2.0, F.col("statistic") / 2.0)).otherwise(p)
    return found.select(*by, "statistic", (F.col("_k") - 1).cast("int").alias("freedom"), p.alias("p_value"), F.sqrt(F.col("statistic") / F.col("_all")).alias("drift_score"))


METHODS = ("ks", "hellinger", "kl", "chi_square")  # and their other spellings


def feature_drift(samples: DataFrame, by: list[str], method: str, stand_ins: bool = False) -> DataFrame:
    """``drift_score`` and ``severity`` per key by one method.

    As in the original, with ``stand_ins`` the divergence is Hellinger's distance and
    chi-square is Kolmogorov-Smirnov's; without it they are what they are called.
    """
    method = known("drift method", method)
    if stand_ins:
        method = {"kl": "hellinger", "chi_square": "ks"}.get(method, method)
    found = {"ks": kolmogorov_smirnov, "hellinger": hellinger, "kl": kullback_leibler, "chi_square": chi_square_numbers}[method](samples, by)
    return found.select(*by, "drift_score", severity(F.col("drift_score")).alias("severity"))


def composition_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per segment of ``after``: change against ``before`` (both: segment, size)."""
    total = before.agg(F.sum("size").alias("_total"))
    both = after.withColumnRenamed("size", "current_size").join(before.withColumnRenamed("size", "previous_size"), "segment", "left").fillna(0, ["previous_size"]).crossJoin(F.broadcast(total))  # one row
    now, then = F.col("current_size"), F.col("previous_size")
    return both.select(
        F.col("segment").alias("segment_name"),
        "previous_size",
        "current_size",
        ratio((now - then) * 100.0, F.col("_total")).alias("size_change_percent"),
        ratio(F.greatest(then - now, F.lit(0)).cast("double"), then).alias("churn_rate"),
        F.when(then > 0, F.greatest(now - then, F.lit(0)) / then).when(now > 0, 1.0).otherwise(0.0).alias("growth_rate"),
    )


def alert_text(feature: Column, score: Column) -> Column:
    return F.format_string("Feature '%s' drift detected: %.4f (%s)", feature, score, severity(score))
