"""K-anonymity, generalisation and noise."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.draws import uniform
from tessella.functions.ranges import cumulative
from tessella.sources.scratch import written


@dataclass
class Budget:
    """A privacy budget; the driver asks it before each noisy action."""

    epsilon: float
    delta: float = 1e-6
    remaining: float = field(init=False)

    def __post_init__(self) -> None:
        self.remaining = self.epsilon

    def consume(self, cost: float) -> bool:
        if cost > self.remaining:
            return False
        self.remaining -= cost
        return True

    @property
    def exhausted(self) -> bool:
        return self.remaining <= 0

    @property
    def percentage(self) -> float:
        return (self.epsilon - self.remaining) / self.epsilon * 100.0


def laplace(x: Column, epsilon: float, sensitivity: float, seed: int, key: Column | None = None) -> Column:
    """x with Laplace noise, 0 at least.

    With ``key`` the noise depends on seed and key alone, so a task that runs
    again or rows dealt differently release the same number; without, on the
    place of the row. Noise hides nothing from those who know the seed, and two
    releases under one seed and key differ by no noise: keep it secret and take
    a new one for each release.
    """
    b, u = sensitivity / epsilon, F.greatest(F.rand(seed), F.lit(1e-300)) if key is None else uniform(key, seed)
    noise = F.when(u < 0.5, b * F.log(2.0 * u)).otherwise(-b * F.log(2.0 * (1.0 - u)))
    return F.greatest(x + noise, F.lit(0.0))


def gaussian(x: Column, epsilon: float, delta: float, sensitivity: float, seed: int, key: Column | None = None) -> Column:
    """x with Gaussian noise, 0 at least; ``key`` as in ``laplace``."""
    sigma = sensitivity * math.sqrt(2.0 * math.log(1.25 / delta)) / epsilon
    noise = F.randn(seed) if key is None else F.sqrt(-2.0 * F.ln(uniform(key, seed, 0))) * F.cos(2.0 * math.pi * uniform(key, seed, 1))
    return F.greatest(x + noise * sigma, F.lit(0.0))


def query_cost(sensitivity: float, accuracy: float) -> float:
    return sensitivity / accuracy


def _keys(identifiers: list[str]) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in identifiers]


def check(rows: DataFrame, identifiers: list[str], k: int) -> DataFrame:
    """Whether all groups of the identifiers have k rows, and what suppression would cost."""
    per = rows.groupBy(*_keys(identifiers)).agg(F.count("*").alias("n"))
    total, lost = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("n") < k, F.col("n"))), F.lit(0))
    return per.agg((lost == 0).alias("is_anonymized"), lost.alias("suppressed_rows"), (total - lost).alias("generalized_rows"), F.when(total > 0, lost * 100.0 / total).otherwise(0.0).alias("information_loss"))


def suppressed(rows: DataFrame, identifiers: list[str], k: int) -> DataFrame:
    """The rows of groups with k or more; groups are counted before they meet the rows."""
    named = {c: f"_k_{c}" for c in identifiers}
    kept = rows.groupBy(*_keys(identifiers)).agg(F.count("*").alias("_n")).where(F.col("_n") >= k).drop("_n").withColumnsRenamed(named)
    same = None
    for c in identifiers:
        one = F.coalesce(rows[c].cast("string"), F.lit("")) == kept[named[c]]
        same = one if same is None else same & one
    return rows.join(kept, same, "left_semi")


def binned(rows: DataFrame, column: str, intervals: int) -> DataFrame:
    """Adds ``bin``: the number of the equal-width interval of the column."""
    ends = rows.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / intervals).otherwise(1.0)
    out = rows.crossJoin(F.broadcast(ends))  # one row
    return out.withColumn("bin", F.least(((F.col(column) - F.col("_lo")) / width).cast("int"), F.lit(intervals - 1))).drop("_lo", "_hi")


def information_loss(rows: DataFrame, column: str, intervals: int) -> DataFrame:
    """Root mean square of (value - middle of its interval) over the range."""
    ends = rows.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    middle = F.col("_lo") + (F.col("bin") + 0.5) * span / intervals
    part = (F.col(column) - middle) / span
    out = binned(rows, column, intervals).crossJoin(F.broadcast(ends))  # one row
    return out.agg(F.coalesce(F.sqrt(F.avg(F.when(span > 0, part * part))), F.lit(0.0)).alias("information_loss"))


def group_sizes(identifiers: list[str]) -> Column:
    return F.count("*").over(Window.partitionBy(*_keys(identifiers)))


def median_cuts(rows: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The rows with ``_group`` and, for each column c, ``c_low`` and ``c_high``: the ends of its group.

    A group is cut at the median of the column that is widest in it, against the
    column's range over all rows, as long as both sides have k rows; where ties
    forbid that, at the next widest. So each group has k rows or more and none
    can be cut. The lower side holds the values below the element at place ⌊n/2⌋.

    A null or NaN is taken as the column's least value. Fewer than k rows give no row.
    All groups of a round are cut at once, from counts of values by ranges, so no
    task has all rows of a group; open groups are written once a round. Columns
    must be numbers.
    """
    if k < 1 or not columns:
        raise ValueError("there must be a column, and k must be positive")
    numbers = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), F.array(*numbers).alias("_x"))
    ends = packed.agg(F.count("*").alias("n"), *[f(F.col("_x")[i]).alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    low = [ends[f"lo{i}"] if ends[f"lo{i}"] is not None else 0.0 for i in range(len(columns))]
    span = [((ends[f"hi{i}"] or 0.0) - low[i]) or 1.0 for i in range(len(columns))]
    filled = F.array(*[F.coalesce(F.col("_x")[i], F.lit(low[i])) for i in range(len(columns))])
    open_ = written(packed.select("_row", filled.alias("_x"), F.lit(0).cast("bigint").alias("_group")).where(F.lit(ends.n >= k)), "cuts")
    closed = []
    while True:
        counted = open_.select("_group", F.posexplode("_x").alias("_c", "_v")).groupBy("_group", "_c", "_v").agg(F.count("*").alias("_k"))
        at = written(cumulative(counted, ["_group", "_c"], [F.col("_v").asc()], {"_upto": "_k"}), "values")
        per = at.groupBy("_group", "_c").agg(F.sum("_k").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        place = F.floor(F.col("_n") / 2)
        middle = at.join(per, ["_group", "_c"]).where((F.col("_upto") - F.col("_k") <= place) & (place < F.col("_upto"))).withColumn("_below", F.col("_upto") - F.col("_k"))
        width = (F.col("_hi") - F.col("_lo")) / F.element_at(F.array(*[F.lit(float(s)) for s in span]), F.col("_c") + 1)
        fits = middle.where((F.col("_below") >= k) & (F.col("_n") - F.col("_below") >= k))
        cuts = written(fits.groupBy("_group").agg(F.max_by(F.struct("_c", "_v"), F.struct(width, -F.col("_c"))).alias("_cut")), "cuts")
        closed.append(open_.join(cuts, "_group", "left_anti"))
        if cuts.isEmpty():
            break
        side = F.element_at("_x", F.col("_cut._c") + 1) >= F.col("_cut._v")
        open_ = written(open_.join(cuts, "_group").select("_row", "_x", F.xxhash64("_group", side).alias("_group")), "cuts")
    done = written(reduce(DataFrame.unionByName, closed), "groups")
    edges = done.groupBy("_group").agg(*[f(F.col("_x")[i]).alias(f"{c}_{n}") for i, c in enumerate(columns) for n, f in (("low", F.min), ("high", F.max))])
    return done.join(edges, "_group").select("_row.*", "_group", *[c for c in edges.columns if c != "_group"])


def cut_loss(cut: DataFrame, columns: list[str]) -> DataFrame:
    """n_groups, least_rows and loss of ``median_cuts``: the mean, over rows and columns, of a group's width as a share of the column's."""
    per = cut.groupBy("_group").agg(F.count("*").alias("n"), *[f(f"{c}_{e}").alias(f"{c}_{e}") for c in columns for e, f in (("low", F.min), ("high", F.max))])
    whole = per.agg(*[f(f"{c}_{e}").alias(f"_{c}_{e}") for c in columns for e, f in (("low", F.min), ("high", F.max))])
    width = lambda c: F.when(F.col(f"_{c}_high") > F.col(f"_{c}_low"), (F.col(f"{c}_high") - F.col(f"{c}_low")) / (F.col(f"_{c}_high") - F.col(f"_{c}_low"))).otherwise(0.0)
    share = sum((width(c) for c in columns[1:]), width(columns[0])) / len(columns)
    return per.crossJoin(F.broadcast(whole)).agg(F.count("*").alias("n_groups"), F.min("n").alias("least_rows"), (F.sum(F.col("n") * share) / F.sum("n")).alias("loss"))  # one row
