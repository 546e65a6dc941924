"""Forecasts, replay of membership, scenarios and momentum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import bands, clamp, ratio, trunc


def line(points: DataFrame, by: list[str]) -> DataFrame:
    """Least-squares line of (x, y) per key: slope, intercept, r_squared (0 for a constant y), and moments."""
    constant = F.var_pop("y") < 1e-10
    return points.groupBy(*by).agg(
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.when(constant, 0.0).otherwise(F.regr_r2("y", "x")).alias("r_squared"),
        F.count("*").alias("n"),
        F.max("x").alias("last_x"),
        F.max_by("y", "x").alias("last_y"),
        (F.regr_syy("y", "x") - F.regr_slope("y", "x") * F.regr_sxy("y", "x")).alias("sse"),
    )


def _ahead(fitted: DataFrame, periods: int) -> DataFrame:
    return fitted.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))


def size_forecast(points: DataFrame, by: list[str], periods: int) -> DataFrame:
    """Sizes ahead of (x = day, y = size), never negative, with a tenth either way; keys need two points."""
    out = _ahead(line(points, by).where("n >= 2 AND slope IS NOT NULL"), periods)
    p = F.greatest(F.col("slope") * (F.col("last_x") + F.col("step")) + F.col("intercept"), F.lit(0.0))
    out = out.withColumn("predicted", p)
    trend = F.when(F.col("slope") > 0.1, "growth").when(F.col("slope") < -0.1, "decline").otherwise("stable")
    return out.select(*by, "step", "predicted", F.greatest(F.col("predicted") * 0.9, F.lit(0.0)).alias("lower"), (F.col("predicted") * 1.1).alias("upper"), trend.alias("trend_type"), "r_squared")


def revenue_forecast(points: DataFrame, by: list[str], periods: int) -> DataFrame:
    """Revenue ahead of (x = 0.., y), with 1.96 standard errors either way; keys need three points."""
    out = _ahead(line(points, by).where("n >= 3"), periods).withColumn("error", F.sqrt(F.greatest(F.col("sse"), F.lit(0.0)) / F.greatest(F.col("n") - 2, F.lit(1))))
    p = F.col("slope") * (F.col("last_x") + F.col("step")) + F.col("intercept")
    return out.select(*by, "step", p.alias("predicted"), (p - 1.96 * F.col("error")).alias("lower"), (p + 1.96 * F.col("error")).alias("upper"), F.col("r_squared").alias("accuracy"))


def composition_forecast(history: DataFrame, by: list[str], ratios: list[str], periods: int) -> DataFrame:
    """Each ratio carried on by its mean step, held within 0 and 1 at each step; the first is the last known."""
    aggs = []
    for r in ratios:
        aggs += [F.min_by(r, "t").alias(f"_a_{r}"), F.max_by(r, "t").alias(f"_b_{r}")]
    at = history.groupBy(*by).agg(F.count("*").alias("_n"), *aggs, (1.0 / (1.0 + F.var_pop(ratios[0]))).alias("composition_stability"))
    steps = F.sequence(F.lit(1), F.lit(periods))
    def walk(r: str) -> Column:
        # A clamped walk never leaves the bound it has met, so each step is the clamped straight line.
        last = F.col(f"_b_{r}")
        move = F.when(F.col("_n") >= 2, (last - F.col(f"_a_{r}")) / (F.col("_n") - 1)).otherwise(0.0)
        return F.transform(steps, lambda i: F.when(i == 1, last).otherwise(clamp(last + move * (i - 1), 0.0, 1.0)))

    out = at.withColumns({f"{r}_forecast": walk(r) for r in ratios})
    return out.select(*by, *[f"{r}_forecast" for r in ratios], "composition_stability")


def replayed(events: DataFrame, target: str) -> DataFrame:
    """Members of each segment at a date, from (segment, seq, date, kind added/removed, member).

    A member is in if its last event up to the date added it; its place is
    that of the first addition after its last removal.
    """
    past = events.where(F.col("date") <= target)
    removed = F.max(F.when(F.col("kind") == "removed", F.col("seq"))).over(Window.partitionBy("segment", "member"))
    since = past.withColumn("_gone", F.coalesce(removed, F.lit(-1))).where((F.col("kind") == "added") & (F.col("seq") > F.col("_gone")))
    return since.groupBy("segment", "member").agg(F.min("seq").alias("since"))


def validity(events: DataFrame) -> DataFrame:
    """Intervals of membership from (segment, seq, date, kind added/removed, member): segment, member, since (seq), begin, end.

    Events of a member are in the order of date, then seq. An interval begins
    with the first addition after a removal and ends where the next removal's
    date begins; the end of an open one is null. An interval that ends on the
    day that it begins is none.
    """
    order = Window.partitionBy("segment", "member").orderBy("date", "seq")
    turns = events.where(F.col("kind").isin("added", "removed")).withColumn("_before", F.lag("kind").over(order))
    turns = turns.where(F.coalesce(F.col("_before") != F.col("kind"), F.col("kind") == "added"))
    ends = turns.withColumn("end", F.lead("date").over(order)).where("kind = 'added'")
    return ends.select("segment", "member", F.col("seq").alias("since"), F.col("date").alias("begin"), "end").where("end IS NULL OR end > begin")


def replayed_at(intervals: DataFrame, dates: DataFrame) -> DataFrame:
    """date, segment, member, since of all members at each of ``dates`` (date).

    Intervals are split by month and meet the dates of that month in an equi-join, so
    that neither a long interval nor a frequent date is compared with all of
    the other side. Nothing is split beyond the last date.
    """
    month = lambda c: F.trunc(F.col(c).cast("date"), "month")
    last = dates.agg(F.max(F.col("date").cast("date")).alias("_last"))
    open_ = intervals.crossJoin(F.broadcast(last)).where(F.col("begin").cast("date") <= F.col("_last"))  # one row
    stop = F.least(F.coalesce(F.col("end").cast("date"), F.col("_last")), F.col("_last"))
    split = open_.withColumn("_month", F.explode(F.sequence(month("begin"), F.trunc(stop, "month"), F.expr("INTERVAL 1 MONTH"))))
    given = dates.select(F.col("date").cast("date").alias("date")).distinct().withColumn("_month", month("date"))
    inside = (F.col("begin").cast("date") <= F.col("date")) & (F.col("end").isNull() | (F.col("date") < F.col("end").cast("date")))
    return split.join(given, "_month").where(inside).select("date", "segment", "member", "since")


def composition_timeline(events: DataFrame, start: str, end: str) -> DataFrame:
    inside = events.where(F.col("date").between(start, end) & F.col("kind").isin("added", "removed"))
    added = F.col("kind") == "added"
    return inside.select("segment", "seq", "date", F.when(added, F.col("member")).alias("added"), F.when(~added, F.col("member")).alias("removed"), F.when(added, 1).otherwise(-1).alias("net_change"))


def member_forecast(members: DataFrame, moves: DataFrame) -> DataFrame:
    """Chances to stay, move and leave for (member, segment) by (from_segment, to_segment, p); ``*`` is staying."""
    per = moves.groupBy(F.col("from_segment").alias("segment")).agg(F.max(F.when(F.col("to_segment") == "*", F.col("p"))).alias("_stay"), F.max_by("to_segment", F.struct("p", "to_segment")).alias("next"), F.max("p").alias("_move"))
    stay, move = F.coalesce("_stay", F.lit(0.6)), F.coalesce("_move", F.lit(0.0))
    return members.join(per, "segment", "left").select("member", "segment", stay.alias("probability_stay"), move.alias("probability_move"), F.greatest(1.0 - stay - move, F.lit(0.0)).alias("probability_churn"), F.coalesce("next", F.lit("unknown")).alias("most_likely_next_segment"), F.greatest(F.greatest(stay, move) - 0.33, F.lit(0.0)).alias("forecast_confidence"))


def what_if(sizes: DataFrame, changes: dict[str, float]) -> DataFrame:
    """Projected sizes of (segment, size) under parameter changes, with what they do in all."""
    projected = F.col("size")
    if "rfm_threshold" in changes:
        projected = trunc(projected * (1.0 + changes["rfm_threshold"] * 0.1))
    if "n_clusters" in changes:
        projected = trunc(projected / changes["n_clusters"])
    out = sizes.withColumn("projected_size", projected.cast("bigint"))
    whole = Window.partitionBy()
    impact = ratio((F.sum("projected_size").over(whole) - F.sum("size").over(whole)) * 100.0, F.sum("size").over(whole))
    return out.withColumns({"projected_revenue_impact": impact, "projected_churn_impact": F.lit(float(changes.get("churn_threshold", 0.0))), "feasibility_score": F.lit(min(max(1.0 - len(changes) / 10.0, 0.0), 1.0))})


def best_scenarios(scenarios: DataFrame) -> DataFrame:
    """Of (seq, scenario, revenue_impact, churn_impact): the last of the highest revenue and the first of the lowest churn."""
    return scenarios.agg(F.max_by("scenario", F.struct("revenue_impact", "seq")).alias("best_revenue_scenario"), F.min_by("scenario", F.struct("churn_impact", "seq")).alias("best_churn_mitigation"))


def sensitivity(base: Column, test: Column, base_segments: Column, test_segments: Column, base_revenue: Column, test_revenue: Column) -> dict[str, Column]:
    moved, segments = test - base, test_segments - base_segments
    slope = F.when(F.abs(moved) > 1e-10, segments / F.when(moved != 0, moved)).otherwise(0.0)
    return {
        "sensitivity_coefficient": slope,
        "elasticity": F.when((F.abs(base) > 1e-10) & (base_segments > 0) & (moved != 0), (segments / base_segments) / (moved / base)).otherwise(0.0),
        "impact_on_segments": F.abs(ratio(segments * 100.0, base_segments)),
        "impact_on_revenue": F.abs(ratio((test_revenue - base_revenue) * 100.0, base_revenue)),
        "risk_level": bands(F.abs(slope), [(">", 2.0, "high"), (">", 1.0, "medium")], "low"),
    }


def tornado(ranges: DataFrame) -> DataFrame:
    """Parameters by the width of their range, widest first."""
    return ranges.select("parameter", F.abs(F.col("high") - F.col("low")).alias("impact")).orderBy(F.desc("impact"), "parameter")


def expansion(current: Column, target: Column, quarters: Column) -> dict[str, Column]:
    """Growth a quarter and return of a plan; the costs of a quarter are constants."""
    hours, marketing, infrastructure = 500.0, 50_000.0, 10_000.0
    return {
        "growth_rate_per_quarter": F.abs((target - current) / quarters / current * 100.0),
        "engineering_hours": hours * quarters,
        "marketing_budget": marketing * quarters,
        "infrastructure_cost": infrastructure * quarters,
        "roi_projection": (target - current) / 100.0 / ((hours + marketing + infrastructure) * quarters) * 10_000.0,
    }


def churn_forecast(history: DataFrame, by: list[str], months: int) -> DataFrame:
    """Churn ahead of (t, rate) with (size, value) per key: rates, members at risk, interventions, revenue."""
    at = history.groupBy(*by).agg(F.min_by("rate", "t").alias("_a"), F.max_by("rate", "t").alias("current_churn_rate"), F.count("*").alias("_n"), F.max("size").alias("_size"), F.max("value").alias("_value"))
    step = F.when(F.col("_n") >= 2, (F.col("current_churn_rate") - F.col("_a")) / F.col("_n")).otherwise(0.0)
    rates = F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda i: F.when(i == 0, F.col("current_churn_rate")).otherwise(clamp(F.col("current_churn_rate") + step * i, 0.0, 1.0)))
    out = at.withColumn("projected_churn_rates", rates)
    mean = F.aggregate("projected_churn_rates", F.lit(0.0), lambda s, v: s + v) / months
    out = out.withColumn("at_risk_members", trunc(F.col("_size") * mean))
    return out.select(*by, "current_churn_rate", "projected_churn_rates", "at_risk_members", trunc(F.col("at_risk_members") * 0.3).alias("intervention_opportunities"), (F.col("at_risk_members") * F.col("_value")).alias("estimated_revenue_at_risk"), (0.65 + F.least(F.col("_n") * 0.05, F.lit(0.25))).alias("confidence"))


# Names of the stages in order.
STAGES = ("prospect", "onboarding", "growth", "mature", "declining", "churn")


def stage_forecast(matrix: DataFrame, current: str, periods: int, corrected: bool = False) -> DataFrame:
    """Probabilities of the six stages after each period, by (from_stage, to_stage, p), and the expected stage.

    Each period is a join with the matrix. As in the original semantics the
    expected stage is the least probable one at the end, the last of equals;
    ``corrected`` takes the most probable.
    """
    spark = matrix.sparkSession
    known = spark.createDataFrame([(s, i) for i, s in enumerate(STAGES)], "stage string, place int")
    at = known.withColumn("p", F.when(F.col("stage") == current, 1.0).otherwise(0.0))
    moves = F.broadcast(matrix.select(F.col("from_stage").alias("stage"), "to_stage", F.col("p").alias("q")))  # 36 rows at most
    rows = None
    for period in range(1, periods + 1):
        reached = at.join(moves, "stage").groupBy(F.col("to_stage").alias("stage")).agg(F.sum(F.col("p") * F.col("q")).alias("p"))
        at = known.join(reached, "stage", "left").fillna(0.0, ["p"])
        now = at.withColumn("period", F.lit(period))
        rows = now if rows is None else rows.unionByName(now)
    order = F.struct("p", "place") if corrected else F.struct(-F.col("p"), F.col("place"))
    best = at.agg(F.max_by("stage", order).alias("expected_next_stage"))
    return rows.crossJoin(F.broadcast(best)).select("period", "stage", "p", "expected_next_stage")  # one row


def momentum(series: DataFrame, by: list[str], lookback: int) -> DataFrame:
    """Momentum over the last values of (t, x), its change, strength and chances; keys need three values."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda s: s["x"])
    at = series.groupBy(*by).agg(ordered.alias("_x")).withColumn("_n", F.size("_x")).where("_n >= 3")
    get = lambda back: F.get("_x", F.col("_n") - 1 - back)
    first = F.get("_x", F.greatest(F.col("_n") - lookback, F.lit(0)))
    m = F.when(F.lit(lookback) >= 2, get(0) - first).otherwise(0.0)
    at = at.withColumn("momentum_score", m)
    m = F.col("momentum_score")
    carries = clamp(F.abs(m) / (F.abs(m) + 5.0), 0.0, 1.0)
    return at.select(*by, get(0).alias("current_value"), "momentum_score", F.when(F.col("_n") >= 4, m - (get(1) - get(3))).otherwise(0.0).alias("acceleration"), bands(F.abs(m), [(">", 5.0, "strong"), (">", 1.0, "moderate")], "weak").alias("trend_strength"), carries.alias("continuation_probability"), (1.0 - carries).alias("reversal_risk"))
