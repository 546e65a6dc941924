"""Emerging audiences, trends, intents, personas, affinities and drivers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import bands, clamp, trunc


def emerging(now: Column, before: Column, periods: Column) -> dict[str, Column]:
    g = F.when(before > 0, (now - before) / F.when(before > 0, before)).when(now > 0, 1.0).otherwise(0.0)
    return {
        "emergence_score": (clamp(g, 0.0, 1.0) + (1.0 - F.least(periods / 12.0, F.lit(1.0)))) / 2.0,
        "growth_rate": g,
        "projected_size_next_period": trunc(now * (1.0 + g)),
        "emergence_status": bands(g, [(">", 0.2, "accelerating"), (">", 0.05, "emerging")], "plateauing"),
    }


def trend(series: DataFrame, by: list[str]) -> DataFrame:
    """Direction, strength, moving average, volatility and accuracy of (t, x); keys need two values."""
    w = Window.partitionBy(*by)
    at = series.withColumn("_i", F.row_number().over(w.orderBy("t"))).withColumn("_n", F.count("*").over(w))
    span = F.least(F.greatest(F.floor(F.col("_n") / 3), F.lit(1)), F.lit(5))
    per = at.groupBy(*by).agg(F.coalesce(F.regr_slope("x", "_i"), F.lit(0.0)).alias("slope"), F.avg(F.when(F.col("_i") > F.col("_n") - span, F.col("x"))).alias("moving_average"), (F.stddev_pop("x") / (F.avg("x") + 0.001)).alias("volatility"), F.count("*").alias("_c")).where("_c >= 2")
    direction = F.when(F.col("slope") > 0.05, "increasing").when(F.col("slope") < -0.05, "decreasing").otherwise("stable")
    return per.select(*by, direction.alias("trend_direction"), F.least(F.abs("slope"), F.lit(1.0)).alias("trend_strength"), "moving_average", "volatility", F.greatest(1.0 - F.least("volatility", F.lit(1.0)), F.lit(0.3)).alias("forecast_accuracy"))


def growth_forecast(series: DataFrame, by: list[str], periods: int) -> DataFrame:
    """Sizes ahead by the mean growth of (t, x), each whole, with the trend of the growth and a band."""
    w = Window.partitionBy(*by).orderBy("t")
    prev = F.lag("x").over(w)
    at = series.withColumn("_g", F.when(prev > 0, (F.col("x") - prev) / F.when(prev > 0, prev)))
    known = at.where("_g IS NOT NULL").withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    early = F.col("_i") < F.floor(F.col("_n") / 2)
    g = known.groupBy(*by).agg(F.avg("_g").alias("_mean"), F.avg(F.when(early, F.col("_g"))).alias("_a"), F.avg(F.when(~early, F.col("_g"))).alias("_b"), F.stddev_pop("_g").alias("_v"), F.count("*").alias("_n"))
    out = series.groupBy(*by).agg(F.max_by("x", "t").alias("current_size")).join(g, by, "left")
    mean, v = F.coalesce("_mean", F.lit(0.0)), F.least(F.coalesce("_v", F.lit(0.2)), F.lit(0.3))
    label = F.when((F.col("_n") >= 2) & (F.col("_b") > F.col("_a") + 0.02), "accelerating").when((F.col("_n") >= 2) & (F.col("_b") < F.col("_a") - 0.02), "decelerating").otherwise("constant")
    sizes = F.transform(F.sequence(F.lit(1), F.lit(periods)), lambda i: trunc(F.greatest(F.col("current_size") * F.pow(1.0 + mean, i.cast("double")), F.lit(0.0))))
    return out.select(*by, "current_size", sizes.alias("forecasted_sizes"), label.alias("growth_rate_trend"), F.greatest(1.0 - v, F.lit(0.5)).alias("lower"), F.least(1.0 + v, F.lit(1.5)).alias("upper"))


def intents(signals: DataFrame, by: str) -> DataFrame:
    """Intent of each key from (signal, strength): whether signs of leaving or of growing weigh more."""
    # Names of signals and intents.
    of = lambda *names: F.sum(F.when(F.col("signal").isin(*names), F.col("strength")).otherwise(0.0))
    leave, grow = of("engagement_declining", "low_recency"), of("engagement_increasing", "high_frequency") + 0.5 * of("high_ltv")
    return signals.groupBy(by).agg(F.when(leave > grow, "high_churn_risk").when(grow > leave, "growth_opportunity").otherwise("stable_engagement").alias("intent_type"), F.avg("strength").alias("confidence"))


def personas(traits: DataFrame, by: str) -> DataFrame:
    """Name and impact of each key's persona from (trait, score); a trait counts for the first family it fits."""
    # Names of personas and the text about them.
    t = F.col("trait")
    family = F.when(t.rlike("churn|risk"), "churn").when(t.rlike("growth|opportunity"), "growth").when(t.rlike("value|ltv|premium"), "value")
    of = lambda k: F.sum(F.when(F.col("_f") == k, F.col("score")).otherwise(0.0))
    c, g, v = of("churn"), of("growth"), of("value")
    name = F.when((c > g) & (c > v), "At-Risk").when(g > v, "Growth-Oriented").when(v > 0.5, "High-Value").otherwise("Engaged")
    out = traits.withColumn("_f", family).groupBy(by).agg(name.alias("name"), F.count("*").alias("_n"), F.avg("score").alias("_s"))
    text = F.format_string("%s customers with %s characteristics. High engagement and targeted approach recommended.", "name", F.when(F.col("_n") > 2, "diverse").otherwise("focused"))
    return out.select(by, "name", text.alias("description"), bands(F.col("_s"), [(">", 0.7, "high"), (">", 0.4, "medium")], "low").alias("business_impact"))


def hidden_opportunities(segments: DataFrame) -> DataFrame:
    """Of (segment, engagement, ltv, dormancy_days), those worth more than 0.2 if they came back."""
    score = F.col("ltv") * F.greatest(1.0 - F.col("engagement"), F.lit(0.0))
    out = segments.withColumn("opportunity_score", score).withColumn("effort_required", bands(F.col("dormancy_days"), [(">", 180, "high"), (">", 90, "medium")], "low"))
    return out.where("opportunity_score > 0.2")


def is_strong_affinity(score: Column, correlation: Column) -> Column:
    return (score > 0.6) & (F.greatest(1.0 + correlation, F.lit(0.1)) > 1.5)


def product_affinities(owned: DataFrame, correlations: DataFrame) -> DataFrame:
    """Affinity of the given pairs (a, b, correlation) by the segments that own (segment, product).

    Only the given pairs are joined, never all pairs of products.
    """
    pairs = correlations.where(F.abs("correlation") > 0.2)
    own = owned.select("segment", "product").distinct()
    has = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("product")).join(own, "product").groupBy("a", "b", "segment").agg(F.countDistinct("product").alias("_k"))
    rate = has.groupBy("a", "b").agg((F.count_if(F.col("_k") == 2) / F.count("*")).alias("co_purchase_rate"), F.array_sort(F.collect_set(F.when(F.col("_k") == 2, F.col("segment")))).alias("segments_affected"))
    out = pairs.join(rate, ["a", "b"], "left").withColumn("co_purchase_rate", F.coalesce("co_purchase_rate", F.lit(0.0)))
    return out.withColumn("affinity_score", (F.abs("correlation") + F.col("co_purchase_rate")) / 2.0).withColumn("lift", F.greatest(1.0 + F.col("correlation"), F.lit(0.1)))


def causal_drivers(importance: DataFrame) -> DataFrame:
    """Kind, direction and significance of (feature, importance, correlation)."""
    r = F.coalesce("correlation", F.lit(0.0))
    strong = F.abs(r) > 0.3
    return importance.select(
        "feature",
        F.when(strong & (r > 0), "positive_driver").when(strong, "negative_driver").otherwise("weak_driver").alias("driver_type"),
        F.col("importance").alias("effect_size"),
        F.when(F.col("importance") > 0.1, 0.01).otherwise(0.5).alias("statistical_significance"),
        F.when(strong & (r > 0), "positive").when(strong, "negative").otherwise("neutral").alias("direction"),
    )


def micro_communities(found: DataFrame) -> DataFrame:
    """Of (community_id, characteristics, cohesion, engagement, growth): members by characteristics, each with the cohesion as score."""
    shared = F.transform("characteristics", lambda c: F.struct(c.alias("name"), F.col("cohesion").alias("score")))
    return found.select("community_id", F.size("characteristics").alias("member_count"), F.col("cohesion").alias("cohesion_score"), shared.alias("shared_characteristics"), F.col("growth").alias("growth_rate"), F.col("engagement").alias("engagement_level"), is_vibrant(F.col("cohesion"), F.col("engagement")).alias("vibrant"))


def tribes(found: DataFrame) -> DataFrame:
    """Of (tribe_id, tribe_name, size, values, influence)."""
    return found.select("tribe_id", "tribe_name", F.col("size").alias("member_count"), F.col("values").alias("core_values"), F.col("influence").alias("influence_score"), F.lit("mainstream").alias("market_relevance"))


def lifecycle_stages(found: DataFrame) -> DataFrame:
    """Of (stage_name, percentage, tenure, behaviors, transition)."""
    return found.select("stage_name", F.col("percentage").alias("percentage_of_base"), F.col("tenure").alias("avg_tenure_days"), F.col("behaviors").alias("key_behaviors"), F.col("transition").alias("transition_rate_to_next"))


def is_vibrant(cohesion: Column, engagement: Column) -> Column:
    return (cohesion > 0.7) & (engagement > 0.6)
