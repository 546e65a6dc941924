"""Price, revenue and market measures of segments, as Column formulas and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import bands, clamp, ratio, trunc
from tessella.functions.ranges import cumulative, same_keys


def elasticity(points: DataFrame) -> DataFrame:
    """Per segment of (segment, seq, price, quantity): mean absolute elasticity of consecutive points, its class, and the price of most revenue."""
    w = Window.partitionBy("segment").orderBy("seq")
    p0, q0 = F.lag("price").over(w), F.lag("quantity").over(w)
    dp, dq = ratio(F.col("price") - p0, p0), ratio(F.col("quantity") - q0, q0)
    at = points.withColumn("_e", F.when(p0.isNull(), None).otherwise(F.when(F.abs(dp) > 1e-10, F.abs(dq / dp)).otherwise(0.0)))
    out = at.groupBy("segment").agg(F.coalesce(F.avg("_e"), F.lit(0.0)).alias("price_elasticity"), F.max_by("price", F.struct(F.col("price") * F.col("quantity"), F.col("seq"))).alias("optimal_price"))
    return out.withColumn("elasticity_classification", bands(F.col("price_elasticity"), [(">", 1.5, "highly_elastic"), (">", 1.0, "elastic"), (">", 0.5, "inelastic")], "highly_inelastic"))


def tier_migration(current: Column, mean: Column) -> dict[str, Column]:
    g = ratio(current - mean, mean)
    return {
        "stay": clamp(1.0 - F.abs(g), 0.0, 1.0),
        "upgrade": F.greatest(g, F.lit(0.0)),
        "downgrade": F.greatest(-g, F.lit(0.0)),
        "most_likely": F.when(g > 0.1, "upgrade").when(g < -0.1, "downgrade").otherwise("stay"),
        "churn_risk": F.when(g < -0.3, 0.8).otherwise(0.2),
    }


def category_affinity(purchases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shares per (segment, category), and the three strongest pairs of each segment.

    Pairs are of a segment's few categories; amounts are summed first.
    """
    per = purchases.groupBy("segment", "category").agg(F.sum("amount").alias("amount"))
    share = per.withColumn("affinity", F.col("amount") / F.sum("amount").over(Window.partitionBy("segment"))).drop("amount")
    b = share.select("segment", F.col("category").alias("other"), F.col("affinity").alias("_b"))
    pairs = share.join(b, "segment").where("category < other").withColumn("score", F.sqrt(F.col("affinity") * F.col("_b")))
    rank = F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("score"), "category", "other"))
    return share, pairs.withColumn("rank", rank).where("rank <= 3").select("segment", F.concat_ws("-", "category", "other").alias("bundle"), "score", "rank")


def price_sensitivity(discounts: DataFrame) -> DataFrame:
    """Response against discount of (segment, discount, response)."""
    s = ratio(F.avg("response"), F.avg("discount"))
    return discounts.groupBy("segment").agg(s.alias("price_sensitivity")).withColumn("sensitivity_class", bands(F.col("price_sensitivity"), [(">", 2.0, "highly_sensitive"), (">", 1.0, "sensitive"), (">", 0.5, "moderate")], "insensitive")).withColumn("willingness_to_pay", clamp(1.0 - F.col("price_sensitivity") / 3.0, 0.0, 1.0))


def discount(sensitivity: Column, ltv: Column) -> dict[str, Column]:
    d = clamp(0.15 * sensitivity, 0.0, 0.5)
    lift = 2.0 * d * sensitivity
    impact = lift * ltv * (1.0 - d)
    return {"optimal_discount": d, "expected_lift": lift, "revenue_impact": impact, "acquisition_impact": 0.3 * lift, "recommended": impact > 0.1}


def best_price(price: Column, e: Column, volume: Column) -> dict[str, Column]:
    """Price that the elasticity suggests, within -20 and 30 per cent, and what it does to revenue."""
    target = F.when(e > 0, price * (1.0 + 0.1 / (e + 1.0))).otherwise(price * 1.1)
    change = clamp((target - price) / price * 100.0, -20.0, 30.0)
    moved = F.when(e != 0, change / F.when(e != 0, e) / 100.0)
    gain = (target * volume * (1.0 + moved) - price * volume) / (price * volume)
    impact = F.when(moved < -0.1, "Volume decline risk").when(moved > 0.1, "Volume growth opportunity").otherwise("Minimal volume impact")
    return {"optimized_price": F.greatest(target, F.lit(0.0)), "price_adjustment": change, "projected_revenue_increase": clamp(gain * 100.0, -30.0, 50.0), "customer_impact": impact}


def competitive(own: Column, mean: Column, low: Column, high: Column) -> dict[str, Column]:
    gap = clamp((own - mean) / mean * 100.0, -50.0, 100.0)
    return {"price_gap": gap, "competitiveness": bands(gap, [("<", -20.0, "very_competitive"), ("<", 0.0, "competitive"), ("<", 20.0, "in_line")], "premium"), "market_position": F.when(own < low, "market_leader").when(own > high, "premium_tier").otherwise("middle_market")}


def thresholds(mean: Column) -> dict[str, Column]:
    return {"acceptable_threshold": 0.8 * mean, "breakeven_threshold": mean, "premium_threshold": 1.5 * mean, "conversion_drop_point": 1.3 * mean}


def demand(current: Column, e: Column, multiplier: Column) -> Column:
    return F.greatest(current * (1.0 + (1.0 - multiplier) * e * 0.5), F.lit(0.0))


def margin(price: Column, cost: Column) -> dict[str, Column]:
    best = F.greatest(cost * 2.2, price)
    return {"current_margin": ratio((price - cost) * 100.0, price), "optimal_price": best, "optimal_margin": ratio((best - cost) * 100.0, best)}


def bundle(total: Column) -> dict[str, Column]:
    price = 0.85 * total
    return {"bundle_price": price, "discount": clamp(ratio((total - price) * 100.0, total), 0.0, 30.0)}


def price_range(market: Column, cost: Column, sensitivity: Column) -> dict[str, Column]:
    low, high = 1.2 * cost, market * (1.0 + 0.3 * sensitivity)
    return {"minimum_price": low, "maximum_price": high, "optimal_price": (low + high) / 2.0, "flexibility": clamp(ratio(high - low, market), 0.0, 1.0)}


def price_change(change: Column, e: Column) -> dict[str, Column]:
    volume = change * e
    revenue = ((1.0 + change) * (1.0 + volume) - 1.0) * 100.0
    return {"projected_volume_change": volume * 100.0, "projected_revenue_change": revenue, "churn_risk_increase": F.greatest(-volume, F.lit(0.0)) * 50.0, "recommendation": F.when(revenue > 5, "Price increase justified by revenue growth").when(revenue < -5, "Price increase will damage revenue; not recommended").otherwise("Minimal revenue impact; proceed with caution")}


def _ranked(revenues: DataFrame, by: str, ascending: bool = False) -> DataFrame:
    """Different values of ``x`` per key with how many members have them (k), how many have them or come before (upto), and all (n, total)."""
    per = revenues.where("x IS NOT NULL").groupBy(by, "x").agg(F.count("*").alias("_k"))
    at = cumulative(per, [by], [F.asc("x") if ascending else F.desc("x")], {"_upto": "_k"})
    return same_keys(at, at.groupBy(by).agg(F.sum("_k").alias("_n"), F.sum(F.col("x") * F.col("_k")).alias("_total")), [by])


def top_share(revenues: DataFrame, by: str, share: float, out: str) -> DataFrame:
    """Share of the total of ``x`` that the top part of the members has, one member at least. Null values are no members."""
    top = F.greatest(F.floor(F.col("_n") * share + 1e-9), F.lit(1))
    kept = F.greatest(F.least(F.col("_upto"), top) - (F.col("_upto") - F.col("_k")), F.lit(0))
    return _ranked(revenues, by).groupBy(by).agg(ratio(F.sum(F.col("x") * kept), F.max("_total")).alias(out))


def segment_revenue(revenues: DataFrame, by: str) -> DataFrame:
    """Total, count, mean, largest share and top-fifth share of ``x``."""
    per = revenues.groupBy(by).agg(F.sum("x").alias("total_revenue"), F.count("*").alias("member_count"), F.avg("x").alias("avg_revenue_per_member"), ratio(F.max("x"), F.sum("x")).alias("largest_share"))
    return per.join(top_share(revenues, by, 0.2, "revenue_concentration"), by)


def concentration(revenues: DataFrame, by: str, corrected: bool = False) -> DataFrame:
    """Herfindahl index, top-tenth share, Gini and risk of ``x``.

    The original Gini ranks in descending order and is 0 for any unequal
    values; ``corrected`` ranks in ascending order.
    """
    at = _ranked(revenues, by, corrected)
    # The ranks of equal values, summed: each is twice its place less the number of members less one.
    ranks = F.col("_k") * (2.0 * (F.col("_upto") - F.col("_k")) + F.col("_k") - F.col("_n"))
    gini = F.greatest(F.sum(ranks * F.col("x")) / (F.max("_n") * F.max("_total")), F.lit(0.0))
    own = F.col("x") / F.col("_total")
    out = at.groupBy(by).agg(F.sum(own * own * F.col("_k")).alias("hhi"), gini.alias("gini"))
    return out.join(top_share(revenues, by, 0.1, "top_share"), by).withColumn("risk", bands(F.col("hhi"), [(">", 0.5, "critical"), (">", 0.25, "high"), (">", 0.21, "medium")], "low"))


def roi(revenue: Column, investment: Column) -> dict[str, Column]:
    r = ratio((revenue - investment) * 100.0, investment)
    return {"roi_percentage": r, "payback_days": F.least(ratio(investment * 365.0, revenue, 10_000.0), F.lit(10_000.0)), "profitability_index": ratio(revenue, investment), "risk": bands(r, [(">", 100.0, "low"), (">", 20.0, "medium"), (">", 0.0, "medium-high")], "high")}


def attribution(revenue: DataFrame, by: str) -> DataFrame:
    """Channel revenue of (segment, seq, channel, x) as a map, the last of equal channels, and its split by touch."""
    last = revenue.groupBy(by, "channel").agg(F.max_by("x", "seq").alias("x"))
    out = last.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "x")))).alias("channel_attribution"), F.sum("x").alias("total"))
    return out.select(by, "channel_attribution", (F.col("total") * 0.25).alias("first_touch"), (F.col("total") * 0.25).alias("last_touch"), (F.col("total") * 0.5).alias("multi_touch"))


def anomalies(current: Column, baseline: Column, mean: Column, std: Column) -> dict[str, Column]:
    z, change = ratio(current - mean, std), ratio((current - baseline) * 100.0, baseline)
    a, b = F.abs(z), F.abs(change)
    severity = F.when((a > 3) | (b > 50), "critical").when((a > 2.5) | (b > 40), "high").otherwise("medium")
    return {"z_score": z, "variance_percentage": change, "alert": (a > 2) | (b > 30), "severity": severity, "alert_type": F.when(current < baseline, "revenue_decline").otherwise("revenue_spike")}


def cac(spend: Column, acquired: Column, monthly: Column) -> dict[str, Column]:
    cost = ratio(spend, acquired.cast("double"))
    payback = F.least(ratio(cost, monthly, 1_000.0), F.lit(1_000.0))
    return {"cac": cost, "payback_months": payback, "efficiency": F.when((payback > 0) & (payback < 12), (12.0 - payback) / 12.0).when(payback == 0, 1.0).otherwise(0.0)}


def margins(revenue: Column, cogs: Column, operating: Column) -> dict[str, Column]:
    per = lambda x: F.when(revenue > 0, x / F.when(revenue == 0, 1.0).otherwise(revenue) * 100.0).otherwise(0.0)
    return {"gross_margin": per(revenue - cogs), "operating_margin": per(revenue - cogs - operating), "net_margin": clamp(per(revenue - cogs - operating), -100.0, 100.0)}


def upsell(penetration: Column, size: Column, order_value: Column) -> dict[str, Column]:
    n = trunc(size * (1.0 - penetration))
    return {"addressable_members": n, "revenue_potential": n * order_value, "priority": bands(penetration, [("<", 0.2, 0.9), ("<", 0.5, 0.7), ("<", 0.8, 0.4)], 0.1)}


def efficiency(revenue: Column, spend: Column, hours: Column, members: Column) -> dict[str, Column]:
    parts = [ratio(revenue, x) for x in (spend, hours, members)]
    score = F.least((parts[0] + parts[1] + parts[2]) / 3.0 / 100.0, F.lit(1.0))
    return {"efficiency_score": score, "efficiency_class": bands(score, [(">", 0.75, "best-in-class"), (">", 0.5, "above-average"), (">", 0.25, "average")], "below-average")}


def cohort_revenue(revenue: Column, members: Column, original: Column) -> dict[str, Column]:
    return {"revenue_per_member": ratio(revenue, members), "retention": ratio(members, original)}


def product_mix(revenue: DataFrame, by: str) -> DataFrame:
    """Herfindahl index, diversity and top product of (segment, product, x)."""
    per = revenue.groupBy(by, "product").agg(F.sum("x").alias("x")).withColumn("_s", F.col("x") / F.sum("x").over(Window.partitionBy(by)))
    return per.groupBy(by).agg(F.sum(F.col("_s") * F.col("_s")).alias("concentration"), (1.0 - F.sum(F.col("_s") * F.col("_s"))).alias("diversity"), F.max("_s").alias("top_share"), F.max_by("product", F.struct("_s", "product")).alias("top_product"))


def growth(before: Column, now: Column, long_ago: Column) -> dict[str, Column]:
    change = ratio((now - before) * 100.0, before)
    cagr = F.when((long_ago > 0) & (now > 0), (F.pow(now / F.when(long_ago == 0, 1.0).otherwise(long_ago), 1.0 / 3.0) - 1.0) * 100.0).otherwise(0.0)
    return {"absolute_growth": now - before, "growth_percentage": change, "cagr": cagr, "growth_class": bands(change, [(">", 20.0, "high-growth"), (">", 5.0, "moderate-growth"), (">", -5.0, "stable"), (">", -20.0, "slow-decline")], "rapid-decline")}


def revenue_health(roi_: Column, growth_: Column, efficiency_: Column, concentration_: Column) -> dict[str, Column]:
    score = 100.0 * (0.35 * clamp((roi_ + 100.0) / 200.0, 0.0, 1.0) + 0.25 * clamp((growth_ + 50.0) / 100.0, 0.0, 1.0) + 0.25 * efficiency_ + 0.15 * (1.0 - concentration_))
    return {"health_score": score, "health_class": bands(score, [(">=", 80.0, "excellent"), (">=", 60.0, "good"), (">=", 40.0, "fair")], "poor")}


def tier_value(tiers: DataFrame, by: str) -> DataFrame:
    """Tier of most value and of most growth among (segment, tier, value, growth)."""
    return tiers.groupBy(by).agg(F.max_by("tier", F.struct("value", "tier")).alias("most_valuable_tier"), ratio(F.max("value"), F.sum("value")).alias("value_concentration"), F.max_by("tier", F.struct("growth", "tier")).alias("fastest_growing_tier"))


def churn_by_tier(tiers: DataFrame, by: str) -> DataFrame:
    """Tiers of most and least churn among (segment, tier, churn); the correlation is a constant where there are several."""
    return tiers.groupBy(by).agg(F.max_by("tier", F.struct("churn", "tier")).alias("highest_churn_tier"), F.min_by("tier", F.struct("churn", "tier")).alias("lowest_churn_tier"), F.when(F.count("*") > 1, 0.65).otherwise(0.0).alias("price_churn_correlation"))
