"""Drift of streamed customer states from mergeable sketches, and clustering anew when it is severe.

Each micro-batch changes the states of some customers. Per feature, the batch
leaves one quantile sketch of the values that came and one of those that they
replaced, and their counts, sums and sums of squares. The states after batch i
are all that came up to i less all that went, so the distribution after any
batch is read from sketches, and a baseline is a batch number. No check reads
the states.

A sketch of size k has a rank error of about 2.3 / k^0.9 of what went into it:
a share c came or went per current customer makes the distribution's error c
times that. With k values or fewer it is exact.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.columns import whole_days
from tessella.functions.names import known
from tessella.operators import drift
from tessella.operators.clustering import fit_kmeans

FEATURES = ("recency", "frequency", "monetary")
#: Size of sketches, and how many parts a distribution is compared in.
SKETCH, GRID = 4_096, 2_048


def changes(updates: DataFrame, as_of: str) -> DataFrame:
    """Per customer of a batch of ``keyed.updates``: the state after it, and the one before it or nulls."""
    now = F.lit(as_of).cast("timestamp").cast("bigint")
    last = lambda c: F.max_by(c, "seq")
    first = lambda c: F.min_by(c, "seq")
    days = lambda ts: whole_days(now - ts.cast("bigint")).cast("double")
    return updates.groupBy("customer_id").agg(
        days(last("ts")).alias("recency"), last("frequency").cast("double").alias("frequency"), last("monetary").alias("monetary"),
        days(first("before_ts")).alias("old_recency"), first("before_frequency").cast("double").alias("old_frequency"), first("before_monetary").alias("old_monetary"),
    )


def sketched(changed: DataFrame, size: int = SKETCH) -> DataFrame:
    """One row per feature: sketches of what came and went, and the moments of the difference."""
    long = changed.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x"), F.col(f"old_{f}").alias("old")) for f in FEATURES])).alias("_")).select("_.*")
    both = lambda f: f(F.col("x")) - F.coalesce(f(F.col("old")), F.lit(0))
    return long.groupBy("feature").agg(
        F.kll_sketch_agg_double("x", F.lit(size)).alias("came"), F.kll_sketch_agg_double("old", F.lit(size)).alias("went"),
        F.count("x").alias("n_came"), F.count("old").alias("n_went"),
        both(F.sum).alias("sum"), both(lambda c: F.sum(c * c)).alias("squares"),
    )


def merged(sketches: DataFrame, upto: int, size: int = SKETCH) -> DataFrame:
    return sketches.where(F.col("batch") <= upto).groupBy("feature").agg(
        F.kll_merge_agg_double("came", F.lit(size)).alias("came"), F.kll_merge_agg_double("went", F.lit(size)).alias("went"),
        F.sum("n_came").alias("n_came"), F.sum("n_went").alias("n_went"), F.sum("sum").alias("sum"), F.sum("squares").alias("squares"),
    )


def customers_after(sketches: DataFrame, upto: int) -> int:
    row = sketches.where((F.col("batch") <= upto) & (F.col("feature") == FEATURES[0])).agg(F.sum(F.col("n_came") - F.col("n_went")).alias("n")).first()
    return row.n or 0


def _cdf(side: DataFrame, feature: str, points: list[float]) -> list[float]:
    """Shares of the current values at or below each point."""
    at = F.array(*[F.lit(p) for p in points])
    shares = lambda c, n: F.when(F.col(n) > 0, F.kll_sketch_get_rank_double(c, at))
    row = side.where(F.col("feature") == feature).select(shares("came", "n_came").alias("came"), shares("went", "n_went").alias("went"), "n_came", "n_went").first()
    went = row.went or [0.0] * len(points)
    n = row.n_came - row.n_went
    return [(c * row.n_came - w * row.n_went) / n for c, w in zip(row.came, went, strict=True)]


def scores(sketches: DataFrame, baseline: int, now: int) -> dict[str, float]:
    """Drift of the states after batch ``now`` from those after ``baseline``: Kolmogorov-Smirnov, for monetary Hellinger. At most GRID points a side come to the driver."""
    sides = [merged(sketches, baseline), merged(sketches, now)]
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    found = {}
    for f in FEATURES[:2]:
        points = sorted({p for side in sides for p in side.where(F.col("feature") == f).select(F.kll_sketch_get_quantile_double("came", grid).alias("q")).first().q})
        found[f] = max(abs(a - b) for a, b in zip(*[_cdf(side, f, points) for side in sides], strict=True))
    moments = []
    for side in sides:
        row = side.where(F.col("feature") == FEATURES[2]).select((F.col("n_came") - F.col("n_went")).alias("n"), "sum", "squares").first()
        mean = row["sum"] / row.n
        moments.append((mean, max(row.squares / row.n - mean * mean, 1e-9)))
    (m0, v0), (m1, v1) = moments
    d = (m0 - m1) ** 2 / (4 * (v0 + v1)) + 0.5 * math.log((v0 + v1) / (2 * math.sqrt(v0 * v1)))
    found[FEATURES[2]] = min(math.sqrt(max(1 - math.exp(-d), 0.0)), 1.0)
    return found


def severity(score: float) -> str:
    return drift.SEVERITIES[sum(score >= limit for limit in (0.1, 0.2, 0.35, 0.5))]


class Watch:
    """A sink of ``keyed.updates`` that sketches each batch, compares it with a baseline, and clusters anew.

    Everything is a table under ``folder``, by batch number, so a batch that
    runs again, or a new session, finds what was there: ``sketches``, ``states``
    (changed ones), ``log`` (a row per feature and check) and ``labels`` of the
    batches that clustered. The log says which baseline the next check takes.
    """

    def __init__(self, spark: SparkSession, folder: str, as_of: str, k: int = 5, least_customers: int = 10, least_severity: str = "high", seed: int = 42):
        self.spark, self.folder, self.as_of = spark, folder, as_of
        self.k, self.least, self.severity, self.seed = k, least_customers, known("drift severity", least_severity), seed

    def _write(self, rows: DataFrame, kind: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{kind}/batch={number}")

    def table(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{kind}")

    def states(self, upto: int) -> DataFrame:
        """All customers' states after a batch."""
        rows = self.table("states").where(F.col("batch") <= upto)
        return rows.groupBy("customer_id").agg(F.max_by(F.struct(*FEATURES), "batch").alias("_")).select("customer_id", "_.*")

    def baseline(self, before: int) -> int | None:
        """The batch that the check of the next batch compares with."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.table("log").where(F.col("batch") < before).agg(F.max_by("next_baseline", "batch").alias("b")).first().b

    def __call__(self, updates: DataFrame, number: int) -> None:
        if updates.isEmpty():
            return
        changed = changes(updates, self.as_of)
        self._write(changed.select("customer_id", *FEATURES), "states", number)
        self._write(sketched(changed), "sketches", number)
        sketches, base = self.table("sketches"), self.baseline(number)
        customers = customers_after(sketches, number)
        if customers < self.least:
            return
        found = scores(sketches, base, number) if base is not None else {}
        drifted = [f for f, s in found.items() if drift.SEVERITIES.index(severity(s)) >= drift.SEVERITIES.index(self.severity)]
        if drifted:
            vector = F.array(*[F.col(c).cast("double") for c in FEATURES])
            states = self.states(number).withColumn("features", vector)
            labels = fit_kmeans(states, min(self.k, customers), seed=self.seed).transform(states)
            self._write(labels.select("customer_id", F.concat(F.lit("cluster_"), F.col("cluster").cast("string")).alias("segment")), "labels", number)
        after = number if drifted or base is None else base
        rows = [(f, s, severity(s), bool(drifted), base, after, customers) for f, s in found.items()] or [("", None, "", False, None, after, customers)]
        self._write(self.spark.createDataFrame(rows, "feature string, drift_score double, severity string, fired boolean, baseline int, next_baseline int, customers bigint").coalesce(1), "log", number)
