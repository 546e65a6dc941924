"""Cohorts, retention and lifecycle stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.columns import bands, ratio

PERIOD_DAYS = {"weekly": 7, "monthly": 30, "quarterly": 90, "yearly": 365}

# Stages with their confidence and expansion potential, and actions.
STAGES = {
    "prospect": (0.9, 0.0, ("Send welcome email with product overview", "Offer first-time purchase discount", "Create onboarding sequence")),
    "onboarding": (0.95, 0.85, ("Guide feature discovery", "Celebrate first purchase", "Send value-building tips")),
    "active": (0.85, 0.7, ("Recommend complementary products", "Send personalized offers", "Request feedback and reviews")),
    "mature": (0.9, 0.6, ("VIP rewards program", "Exclusive early access", "Loyalty recognition")),
    "at_risk": (0.8, 0.4, ("Targeted win-back campaign", "Special re-engagement offer", "Personalized product recommendations")),
    "dormant": (0.75, 0.0, ("Reactivation campaign", "Incentivized return offer", "Survey for feedback")),
    "churned": (0.85, 0.0, ("Final win-back attempt", "Exit survey", "Sunset workflow")),
}
EVENT_STAGE = {"signup": "prospect", "first_purchase": "onboarding", "purchase": "active", "inactivity": "at_risk", "churn": "churned"}


def cohort_number(epoch_seconds: Column, period: str) -> Column:
    """Number of the fixed-length period since the epoch; divisions go towards zero."""
    return ((epoch_seconds / 86_400).cast("bigint") / PERIOD_DAYS[period]).cast("bigint")


def cohort_id(epoch_seconds: Column, period: str) -> Column:
    return F.concat(F.lit("cohort_"), cohort_number(epoch_seconds, period).cast("string"))


def created(members: DataFrame) -> DataFrame:
    """Per cohort of (cohort_id, ltv, retained boolean): size, revenue, averages."""
    retention = F.avg(F.col("retained").cast("double"))
    return members.groupBy("cohort_id").agg(F.count("*").alias("size"), F.sum("ltv").alias("revenue"), F.avg("ltv").alias("avg_ltv"), retention.alias("retention_rate_total"), (1.0 - retention).alias("churn_rate_total"))


def curve(activity: DataFrame, sizes: DataFrame) -> DataFrame:
    """Retention points: (cohort_id, age, retained_count) against (cohort_id, size)."""
    share = ratio(F.col("retained_count").cast("double"), F.col("size"))
    return activity.join(sizes.select("cohort_id", "size"), "cohort_id").withColumn("retention_rate", share).withColumn("churn_rate", 1.0 - share)


def decay_rate(points: DataFrame) -> DataFrame:
    """Change of retention per period from the first to the last point of (cohort_id, age, retention_rate)."""
    first, last = F.min_by("retention_rate", "age"), F.max_by("retention_rate", "age")
    span = (F.max("age") - F.min("age")).cast("double")
    return points.groupBy("cohort_id").agg(first.alias("a"), last.alias("b"), span.alias("s")).select("cohort_id", F.when(F.col("s") > 0, (F.col("b") - F.col("a")) / F.col("s")).otherwise(0.0).alias("decay_rate"))


def table_of(points: DataFrame, ages: list[int]) -> DataFrame:
    """One row per cohort, one column per age, 0 where there is no point."""
    return points.groupBy("cohort_id").pivot("age", ages).agg(F.first("retention_rate")).fillna(0.0)


def revenue_per_retained(points: DataFrame, cohorts: DataFrame) -> DataFrame:
    last = points.groupBy("cohort_id").agg(F.max_by("retained_count", "age").alias("n"))
    return cohorts.join(last, "cohort_id").select("cohort_id", ratio(F.col("revenue"), F.col("n").cast("double")).alias("revenue_per_retained"))


def compared(cohorts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Differences b - a for (cohort_a, cohort_b); b is better only if its retention is greater."""
    side = lambda k: cohorts.select(F.col("cohort_id").alias(f"cohort_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in ("size", "revenue", "avg_ltv", "retention_rate_total")])
    both = pairs.join(side("a"), "cohort_a").join(side("b"), "cohort_b")
    gap = lambda c: F.col(f"{c}_b") - F.col(f"{c}_a")
    better = F.when(gap("retention_rate_total") > 0, F.col("cohort_b")).otherwise(F.col("cohort_a"))
    return both.select("cohort_a", "cohort_b", gap("size").alias("size_diff"), gap("revenue").alias("revenue_diff"), gap("avg_ltv").alias("ltv_diff"), gap("retention_rate_total").alias("retention_rate_diff"), better.alias("better_performer"))


def aggregated(cohorts: DataFrame) -> DataFrame:
    return cohorts.groupBy("cohort_id").agg(F.sum("size").alias("total_size"), F.sum("revenue").alias("total_revenue"), F.avg("retention_rate_total").alias("avg_retention"), F.count("*").alias("cohort_count"))


def ranking(cohorts: DataFrame) -> DataFrame:
    """The best cohort is the last of the highest retention, the worst the first of the lowest."""
    at = F.struct("retention_rate_total", "cohort_id")
    return cohorts.agg(F.max_by("cohort_id", at).alias("best"), F.min_by("cohort_id", at).alias("worst"))


def stage(signup_days: Column, purchases: Column, last_days: Column) -> Column:
    return (
        F.when((purchases == 0) & (signup_days < 30), "prospect")
        .when(purchases == 0, "dormant")
        .when(signup_days < 30, "onboarding")
        .when(last_days > 180, "dormant")
        .when(last_days > 90, "at_risk")
        .when(signup_days > 730, "mature")
        .otherwise("active")
    )


def lifecycle(customers: DataFrame) -> DataFrame:
    """Stage and scores of (customer_id, signup_days, purchases, total_value, last_days, frequency)."""
    of = lambda k: F.element_at(F.create_map(*[F.lit(x) for name, v in STAGES.items() for x in (name, v[k])]), F.col("current_stage"))
    out = customers.withColumn("current_stage", stage(F.col("signup_days"), F.col("purchases"), F.col("last_days")))
    retention = (1.0 - F.least(F.col("last_days") / 365.0, F.lit(1.0)) + F.least(F.col("frequency") / 10.0, F.lit(1.0))) / 2.0
    return out.withColumns({"stage_confidence": of(0), "expansion_potential": of(1), "retention_score": retention, "avg_order_value": ratio(F.col("total_value"), F.col("purchases").cast("double"))})


def stage_actions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, list(v[2])) for k, v in STAGES.items()], "stage string, actions array<string>")


def stage_distribution(profiles: DataFrame) -> DataFrame:
    per = profiles.groupBy("current_stage").agg(F.count("*").alias("n"))
    return per.select(F.col("current_stage").alias("stage"), (F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())).alias("percentage"))


def at_risk_vips(profiles: DataFrame, threshold: float) -> DataFrame:
    return profiles.where((F.col("total_value") > threshold) & F.col("current_stage").isin("at_risk", "dormant") & (F.col("retention_score") < 0.5))


def transitions(journeys: DataFrame) -> DataFrame:
    """Transition probabilities and mean days from (customer_id, ts epoch seconds, seq, event_type).

    An event of another type keeps the stage before it. Days between two
    events are whole, and so is their mean.
    """
    w = Window.partitionBy("customer_id").orderBy("ts", "seq")
    named = F.create_map(*[F.lit(x) for kv in EVENT_STAGE.items() for x in kv])[F.col("event_type")]
    at = journeys.withColumn("own", named).withColumn("to_stage", F.last("own", ignorenulls=True).over(w))
    at = at.withColumn("from_stage", F.lag("to_stage").over(w)).withColumn("days", ((F.col("ts") - F.lag("ts").over(w)) / 86_400).cast("bigint"))
    moved = at.where(F.col("from_stage").isNotNull() & (F.col("from_stage") != F.col("to_stage")))
    per = moved.groupBy("from_stage", "to_stage").agg(F.count("*").alias("sample_count"), F.sum("days").alias("days"))
    total = F.sum("sample_count").over(Window.partitionBy("from_stage"))
    return per.select("from_stage", "to_stage", (F.col("sample_count") / total).alias("probability"), (F.col("days") / F.col("sample_count")).cast("bigint").alias("avg_time_in_days"), "sample_count")


def next_stage(moves: DataFrame) -> DataFrame:
    """Per stage the likeliest transition; of equals, the first by name."""
    order = Window.partitionBy("from_stage").orderBy(F.desc("probability"), "to_stage")
    return moves.withColumn("_i", F.row_number().over(order)).where("_i = 1").select("from_stage", F.col("to_stage").alias("next_stage"), F.col("avg_time_in_days").alias("time_to_next"))


def tenure_band(days: Column) -> Column:
    return bands(days, [("<", 30, "new"), ("<", 365, "growing")], "established")
