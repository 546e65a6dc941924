"""Per-customer state over a stream of events, windows, and drift-triggered clustering.

Events are (customer_id, event_type, value, ts). A customer's state is its
count, sum and latest time; the same aggregation serves batch and stream, the
stream keeping it in the state store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import epoch, ratio, whole_days
from tessella.functions.names import known
from tessella.functions.ranges import cumulative, preceding

#: Events of one customer that a task orders.
ONE_TASK = 1_000_000
WINDOWS = {"minute": "1 minute", "hour": "1 hour", "day": "1 day", "week": "7 days"}


def state(events: DataFrame, as_of: str, latest: str = "max") -> DataFrame:
    """Recency, frequency and monetary of each customer.

    ``latest`` is the time that counts as last: the largest, or ``arrived``,
    that of the event with the largest ``seq``.
    """
    t = epoch(F.col("ts"))
    last = F.max(t) if latest == "max" else F.max_by(t, F.col("seq"))
    return events.groupBy("customer_id").agg(F.count("*").alias("frequency"), F.sum("value").alias("monetary"), last.alias("last_ts")).withColumn("recency", whole_days(F.lit(as_of).cast("timestamp").cast("bigint") - F.col("last_ts")))


def scores(recency: Column, frequency: Column, monetary: Column) -> tuple[Column, Column, Column]:
    hundred = F.lit(100.0)
    return hundred - F.least(recency.cast("double"), hundred), F.least(frequency.cast("double"), hundred), F.least(monetary / 1000.0, hundred)


def segment5(r: Column, f: Column, m: Column) -> Column:
    """Five labels from the mean of the three scores."""
    mean = (r + f + m) / 3.0
    return F.when(mean >= 80, "Champions").when(mean >= 60, "Loyal Customers").when(mean >= 40, "Potential Loyalists").when(mean >= 20, "At Risk").otherwise("Lost")


def labelled(states: DataFrame) -> DataFrame:
    return states.withColumn("segment", segment5(*scores(F.col("recency"), F.col("frequency"), F.col("monetary"))))


def distribution(segments: DataFrame) -> DataFrame:
    return segments.groupBy("segment").agg(F.count("*").alias("customers"))


def window_stats(events: DataFrame, kind: str, late: str | None = None) -> DataFrame:
    """Sum, count, mean, ends of the values in each tumbling window; ``late`` is the watermark of a stream."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.window("ts", WINDOWS[known("window", kind)]).alias("_w")).agg(F.sum("value").alias("total"), F.count("*").alias("count"), F.avg("value").alias("average"), F.max("value").alias("max"), F.min("value").alias("min"))
    return out.select(F.col("_w.start").alias("window_start"), "total", "count", "average", "max", "min")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of each customer, ended by a gap."""
    out = events.groupBy("customer_id", F.session_window("ts", gap).alias("_w")).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select("customer_id", F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "events", "total")


def event_rate(events: DataFrame, window_seconds: int, corrected: bool = False) -> DataFrame:
    """Events a window of each customer.

    The original rate is the same for all customers and counts no events:
    the window over a thousandth of the whole span. ``corrected`` counts.
    """
    t = epoch(F.col("ts"))
    span = F.greatest(F.max(t) - F.min(t), F.lit(1))
    if corrected:
        return events.groupBy("customer_id").agg((F.count("*") * window_seconds / span).alias("rate"))
    one = events.agg((window_seconds / (span / 1000.0)).alias("rate"))
    return events.select("customer_id").distinct().crossJoin(F.broadcast(one))  # one row


def high_value(states: DataFrame, threshold: float) -> DataFrame:
    return states.where(F.col("monetary") > threshold)


def churn_signals(states: DataFrame, days: int) -> DataFrame:
    return states.where(F.col("recency") > days)


def smoothed(current: Column, new: Column, alpha: float) -> Column:
    return alpha * new + (1.0 - alpha) * current


def updates(events: DataFrame, as_of: str) -> DataFrame:
    """For each event in order of seq: the customer's label before and after it.

    Where no customer has more than ONE_TASK events, one shuffle deals them by
    customer. Otherwise no task orders all events of a customer; counts and
    sums run by ranges. A null value adds nothing. A customer's seq are unique.
    """
    now = F.lit(as_of).cast("timestamp").cast("bigint")
    rows = events.select("customer_id", "seq", "ts", F.coalesce("value", F.lit(0.0)).alias("_value"), F.lit(1).alias("_one"))
    most = events.groupBy("customer_id").count().agg(F.max("count")).first()[0] or 0
    each = Window.partitionBy("customer_id").orderBy("seq")
    if most <= ONE_TASK:
        upto = each.rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({"_n": F.sum("_one").over(upto), "_total": F.sum("_value").over(upto)})
    else:
        rows = cumulative(rows, ["customer_id"], [F.col("seq").asc()], {"_n": "_one", "_total": "_value"})
    s = scores(whole_days(now - epoch(F.col("ts"))), F.col("_n"), F.col("_total"))
    out = rows.select("customer_id", "seq", segment5(*s).alias("new_segment"))
    if most <= ONE_TASK:
        out = out.withColumn("previous_segment", F.lag("new_segment").over(each))
    else:
        out = preceding(out, ["customer_id"], "seq", {"previous_segment": "new_segment"})
    changed = F.coalesce(F.col("previous_segment") != F.col("new_segment"), F.lit(True))
    return out.select("customer_id", "seq", "previous_segment", "new_segment", changed.alias("changed"), F.lit(0.85).alias("confidence"))


def rate_of_change(now: Column, before: Column) -> Column:
    return ratio(now - before, before)


def start_states(events: DataFrame, as_of: str, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Starts a stream that hands each batch's changed states, labelled, to ``sink``.

    The sink gets (states, batch number) and may write them where it likes; a
    batch that is run again has the same number.
    """
    rows = labelled(state(events, as_of))
    return rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(**(trigger or {"availableNow": True})).start()


class Recluster:
    """A sink that keeps a baseline of states and clusters anew when they drift from it.

    ``states`` is a function that reads all current states; only the drift
    figures and the centres of the model come to the driver.
    """

    def __init__(self, states: Callable[[], DataFrame], k: int = 5, least_customers: int = 10, severity: str = "high"):
        self.states, self.k, self.least, self.severity = states, k, least_customers, known("drift severity", severity)
        self.baseline: DataFrame | None = None
        self.history: list[dict] = []

    def check(self) -> DataFrame | None:
        """Drift of recency and frequency by Kolmogorov-Smirnov and of monetary by Hellinger distance; None before there is a baseline."""
        from tessella.operators import drift

        if self.baseline is None:
            return None
        both = self.baseline.withColumn("side", F.lit(0)).unionByName(self.states().select("recency", "frequency", "monetary").withColumn("side", F.lit(1)))
        long = both.select("side", *[F.col(c).cast("double").alias(c) for c in ("recency", "frequency", "monetary")]).unpivot("side", ["recency", "frequency", "monetary"], "feature", "x")
        found = drift.kolmogorov_smirnov(long.where("feature <> 'monetary'"), ["feature"]).unionByName(drift.hellinger(long.where("feature = 'monetary'"), ["feature"]))
        return found.withColumn("severity", drift.severity(F.col("drift_score")))

    def arm(self) -> None:
        from tessella.sources.scratch import written

        self.baseline = written(self.states().select("recency", "frequency", "monetary"), "baseline")

    def __call__(self, batch: DataFrame, number: int) -> DataFrame | None:
        """Arms once there are customers enough; later returns new labels where the drift is severe."""
        from tessella.operators import drift
        from tessella.operators.clustering import fit_kmeans

        states = self.states()
        n = states.count()
        if n < self.least:
            return None
        if self.baseline is None:
            self.arm()
            return None
        worst = self.check().where(drift.severity_rank(F.col("severity")) >= drift.SEVERITIES.index(self.severity))
        if worst.isEmpty():
            return None
        vector = F.array(*[F.col(c).cast("double") for c in ("recency", "frequency", "monetary")])
        model = fit_kmeans(states.withColumn("features", vector), min(self.k, n), seed=42)
        self.history.append({"batch": number, "customers": n, "drifted": [r.feature for r in worst.collect()]})
        self.arm()
        return model.transform(states.withColumn("features", vector)).withColumn("segment", F.concat(F.lit("cluster_"), F.col("cluster").cast("string"))).drop("features", "cluster")
