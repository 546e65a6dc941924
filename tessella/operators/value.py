"""Churn scores, customer lifetime value and short forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import bands, clamp, ratio
from tessella.functions.ranges import cumulative

# Bounds and names of the risks.
RISK_BANDS = [("<", 0.1, "very_low"), ("<", 0.25, "low"), ("<", 0.5, "medium"), ("<", 0.75, "high")]


def churn_logistic(recency: Column, frequency: Column, monetary: Column, tenure: Column, engagement: Column, tickets: Column) -> Column:
    """Logistic score of capped features."""
    cap = lambda x, top: F.least(x / top, F.lit(1.0))
    z = F.lit(-0.5) + 0.35 * cap(recency, 90.0) - 0.4 * cap(frequency, 20.0) - 0.3 * cap(monetary, 5000.0) - 0.15 * cap(tenure, 1000.0) - 0.25 * F.least(engagement, F.lit(1.0)) + 0.1 * tickets
    return 1.0 / (1.0 + F.exp(-z))


def churn_ensemble(recency: Column, frequency: Column, monetary: Column, tenure: Column, engagement: Column) -> Column:
    """Mean of five one-feature rules."""
    votes = [
        bands(engagement, [("<", 0.3, 0.75), ("<", 0.6, 0.5)], 0.2),
        bands(recency, [(">", 60.0, 0.8), (">", 30.0, 0.5)], 0.15),
        bands(monetary, [("<", 100.0, 0.7), ("<", 500.0, 0.4)], 0.15),
        bands(frequency, [("<", 2.0, 0.65), ("<", 5.0, 0.35)], 0.1),
        bands(tenure, [("<", 90.0, 0.6), ("<", 365.0, 0.3)], 0.1),
    ]
    return sum(votes[1:], votes[0]) / 5.0


def risk_level(p: Column) -> Column:
    return bands(p, RISK_BANDS, "critical")


def days_until_churn(p: Column, recency: Column) -> Column:
    return F.greatest(F.lit(90) - (90.0 * p).cast("int") + (recency / 30.0).cast("int"), F.lit(1))


def importances(recency: Column, frequency: Column, monetary: Column) -> Column:
    """Weight of each feature, larger where the feature is out of line."""
    # Bounds and weights.
    return F.struct(
        F.when(recency > 60, 0.45).otherwise(0.35).alias("recency"),
        F.when(frequency < 2, 0.35).otherwise(0.25).alias("frequency"),
        F.when(monetary < 100, 0.35).otherwise(0.25).alias("monetary"),
        F.lit(0.15).alias("engagement"),
    )


def retention_action(p: Column, monetary: Column, engagement: Column) -> Column:
    """What to do about a customer at risk, with the chance that it helps."""
    # Kinds of action and texts of offers.
    kind = F.when(engagement < 0.3, "email_campaign").when(monetary < 100, "discount").otherwise("vip_support")
    level = risk_level(p)
    offer = F.when(level == "critical", "20% discount + priority support").when(level == "high", "15% discount").when(level == "medium", "10% discount")
    return F.struct(kind.alias("action_type"), level.alias("urgency"), offer.alias("recommended_offer"), (1.0 - p).alias("estimated_save_probability"))


def churn_summary(scored: DataFrame, by: str) -> DataFrame:
    """Per cohort of (by, p): counts, mean probability, value at risk."""
    critical, high = F.count_if(risk_level(F.col("p")) == "critical"), F.count_if(risk_level(F.col("p")) == "high")
    return scored.groupBy(by).agg(
        F.count("*").alias("customer_count"),
        F.avg("p").alias("avg_churn_probability"),
        critical.alias("critical_churn_count"),
        high.alias("high_churn_count"),
        (1.0 - F.avg("p")).alias("retention_potential"),
        ((critical + high) * 500.0).alias("estimated_ltv_at_risk"),
    )


def confusion(scored: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of (actual boolean, p) at 0.5; zeros on empty input."""
    yes, said = F.col("actual"), F.col("p") > 0.5
    counts = scored.agg(F.count("*").alias("n"), F.count_if(yes & said).alias("tp"), F.count_if(~yes & said).alias("fp"), F.count_if(yes & ~said).alias("fn"), F.count_if(~yes & ~said).alias("tn"))
    precision, recall = ratio(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), ratio(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    out = counts.withColumn("accuracy", ratio((F.col("tp") + F.col("tn")).cast("double"), F.col("n"))).withColumn("precision", precision).withColumn("recall", recall)
    return out.withColumn("f1_score", ratio(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumnRenamed("n", "training_samples")


def auc_roc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve of (actual, p), ties taken together; 0.5 if a class is absent.

    Scores are counted first, so what the cumulative sums run over is one row
    per distinct score.
    """
    per = scored.groupBy("p").agg(F.count_if("actual").alias("pos"), F.count_if(~F.col("actual")).alias("neg"))
    before = F.col("_upto") - F.col("pos")
    area = cumulative(per, [], [F.desc("p")], {"_upto": "pos"}).select("pos", "neg", (F.col("neg") * (before + F.col("pos") / 2.0)).alias("part"))
    total = area.agg(F.sum("part").alias("s"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return total.select(F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("s") / (F.col("pos") * F.col("neg"))).otherwise(0.5).alias("auc_roc"))


def simple_ltv(spent: Column, purchases: Column, days: Column, lifespan: Column) -> dict[str, Column]:
    """Lifetime value from average order and frequency."""
    idle = (purchases == 0) | (days == 0)
    order, yearly = ratio(spent, purchases.cast("double")), ratio(purchases * 365.0, days.cast("double"))
    annual = order * yearly
    p = bands(yearly, [("<", 1.0, 0.25), ("<", 3.0, 0.15), ("<", 6.0, 0.05)], 0.0) + bands(order, [("<", 100.0, 0.15), ("<", 500.0, 0.08)], 0.0)
    or_ = lambda value, otherwise: F.when(idle, otherwise).otherwise(value)
    return {
        "historical_value": spent,
        "annual_value": or_(annual, F.lit(0.0)),
        "predicted_ltv": or_(annual * lifespan / 365.0, spent),
        "predicted_ltv_3yr": or_(annual * 3.0 * 0.85, spent),
        "predicted_ltv_5yr": or_(annual * 5.0 * 0.7, spent),
        "churn_probability": or_(F.least(p, F.lit(1.0)), F.lit(0.5)),
        "confidence_score": or_(F.lit(0.75), F.lit(0.3)),
    }


def probabilistic_ltv(spent: Column, purchases: Column, days: Column, recency: Column, score: Column, p: Column) -> dict[str, Column]:
    """Lifetime value weighted by scores (0 to 15), recency and survival."""
    idle = (purchases == 0) | (days == 0)
    annual = ratio(spent, purchases.cast("double")) * ratio(purchases * 365.0, days.cast("double"))
    by_score = clamp(score / 15.0, 0.5, 1.0)
    by_recency = bands(recency, [("<", 30, 1.0), ("<", 90, 0.85), ("<", 180, 0.65)], 0.4)
    base = annual * 3.0 * by_score * by_recency
    kept = 1.0 - p
    or_ = lambda value, otherwise: F.when(idle, F.lit(otherwise)).otherwise(value)
    return {"predicted_ltv": or_(base * kept, 0.0), "predicted_ltv_3yr": or_(base * F.pow(kept, 3.0), 0.0), "predicted_ltv_5yr": or_(base * F.pow(kept, 5.0), 0.0), "confidence_score": or_(F.least(by_score * by_recency, F.lit(0.95)), 0.4)}


def churn_score(recency: Column, frequency: Column, monetary: Column, tenure: Column) -> dict[str, Column]:
    """Additive churn score, halved, with its risk level."""
    total = (
        bands(recency, [("<", 30, 0.05), ("<", 90, 0.15), ("<", 180, 0.35)], 0.65)
        + bands(frequency, [("<", 1.0, 0.25), ("<", 3.0, 0.15), ("<", 6.0, 0.05)], 0.0)
        + bands(monetary, [("<", 100.0, 0.15), ("<", 500.0, 0.08)], 0.0)
        + bands(tenure, [("<", 90, 0.2), ("<", 365, 0.1)], 0.0)
    )
    p = F.least(total / 2.0, F.lit(1.0))
    return {"churn_probability": p, "risk_level": bands(p, [(">", 0.65, "critical"), (">", 0.45, "high"), (">", 0.25, "medium")], "low"), "days_until_churn": F.when(p > 0.3, recency + 30), "retention_score": 1.0 - p}


def projected_revenue(monthly: Column, trend: Column, risk: Column, days: Column) -> dict[str, Column]:
    """Revenue of a period ahead under compound growth and survival, with a band of a quarter around what survives."""
    g, months = trend * 0.15, days / 30.0
    total = F.when(F.abs(g) < 0.01, monthly * months).otherwise(monthly * ratio(F.pow(1.0 + g, months) - 1.0, g))
    label = bands(days, [("<=", 30, "30d"), ("<=", 90, "90d"), ("<=", 365, "1y"), ("<=", 1095, "3y")], "5y")
    adjusted = total * F.pow(1.0 - risk, months / 12.0)
    return {"period": label, "projected_revenue": total, "growth_rate": g, "low": adjusted * 0.75, "high": adjusted * 1.25, "risk_adjusted_revenue": adjusted}


def segment_clv(customers: DataFrame, by: str) -> DataFrame:
    """Per segment of (by, spent, purchases, days): total, averages, mean annualised value."""
    annual = F.when(F.col("days") > 0, F.col("spent") * 365.0 / F.col("days")).otherwise(F.col("spent"))
    return customers.groupBy(by).agg(
        F.sum("spent").alias("total_value"), F.avg("spent").alias("avg_customer_value"), ratio(F.sum("spent"), F.sum("purchases").cast("double")).alias("avg_order_value"), F.avg(annual).alias("segment_ltv"), F.count("*").alias("customer_count")
    )


def smoothed(series: DataFrame, by: list[str], alpha: float, periods: int) -> DataFrame:
    """Flat forecast of exponential smoothing over (t, x) of each key; one key's series is one array."""
    ordered = F.array_sort(F.collect_list(F.struct("t", "x")))
    level = F.aggregate(F.slice(F.col("_s"), 2, 1_000_000_000), F.col("_s")[0]["x"], lambda s, r: alpha * r["x"] + (1.0 - alpha) * s)
    return series.groupBy(*by).agg(ordered.alias("_s")).select(*by, level.alias("forecast"), F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step"))


def moving_average(series: DataFrame, by: list[str], size: int) -> DataFrame:
    """Mean of each full trailing window of (t, x)."""
    w = Window.partitionBy(*by).orderBy("t")
    trailing = w.rowsBetween(-(size - 1), 0)
    return series.withColumn("mean", F.avg("x").over(trailing)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") >= size).drop("_n", "x")


def halves_trend(series: DataFrame, by: list[str]) -> DataFrame:
    """Relative change of the mean from the first half of (t, x) to the second, within -1 and 1."""
    w = Window.partitionBy(*by)
    at = series.withColumn("_i", F.row_number().over(w.orderBy("t")) - 1).withColumn("_n", F.count("*").over(w))
    early = F.col("_i") < F.floor(F.col("_n") / 2)
    means = at.groupBy(*by).agg(F.avg(F.when(early, F.col("x"))).alias("a"), F.avg(F.when(~early, F.col("x"))).alias("b"), F.count("*").alias("n"))
    return means.select(*by, F.when(F.col("n") < 2, 0.0).otherwise(clamp((F.col("b") - F.col("a")) / F.greatest(F.col("a"), F.lit(0.01)), -1.0, 1.0)).alias("trend"))
