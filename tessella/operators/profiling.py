"""Segment profiles and the measures of segment intelligence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import bands, clamp, dot, ratio
from tessella.functions.ranges import quarters, same_keys


def statistics(rows: DataFrame) -> DataFrame:
    """Per (segment, feature) of long rows (segment, feature, x): mean, median, deviation, ends, quarter values, importance.

    Null values don't count; a segment of any size is ordered in ranges.
    """
    by = ["segment", "feature"]
    plain = rows.groupBy(*by).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    out = same_keys(plain, quarters(rows, by), by).select(*by, "n", "mean", "median", "std", "min", "max", F.col("p25").alias("q25"), F.col("p75").alias("q75"))
    return out.withColumn("importance", F.col("std") / (F.col("max") - F.col("min") + 1e-10))


def separation(rows: DataFrame) -> DataFrame:
    """Per segment, the mean over features of how far its mean is from that of all others."""
    total = rows.groupBy("feature").agg(F.count("*").alias("all_n"), F.sum("x").alias("all_s"), F.sum(F.col("x") * F.col("x")).alias("all_q"))
    own = rows.groupBy("segment", "feature").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    both = own.join(total, "feature").where("all_n > n")
    m1, m2 = F.col("s") / F.col("n"), (F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n"))
    deviation = lambda q, n, m: F.sqrt(F.greatest(q / n - m * m, F.lit(0.0)))
    mean = (deviation(F.col("q"), F.col("n"), m1) + deviation(F.col("all_q") - F.col("q"), F.col("all_n") - F.col("n"), m2)) / 2.0
    part = F.when(mean < 1e-10, 0.0).otherwise(F.least(F.abs(m1 - m2) / mean, F.lit(2.0)) / 2.0)
    return both.groupBy("segment").agg(F.avg(part).alias("separation"))


def purity(labelled: DataFrame) -> DataFrame:
    """Share of the commonest label of each (segment, label)."""
    per = labelled.groupBy("segment", "label").agg(F.count("*").alias("n"))
    return per.groupBy("segment").agg((F.max("n") / F.sum("n")).alias("purity"))


def stability(size: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-size / 100.0))


def cohesion(stats: DataFrame) -> DataFrame:
    """1 less half the mean coefficient of variation, per segment."""
    cv = F.when(F.abs(F.col("mean")) > 1e-10, F.col("std") / F.abs(F.col("mean")))
    return stats.groupBy("segment").agg((1.0 - F.least(F.coalesce(F.avg(cv), F.lit(1.0)) / 2.0, F.lit(1.0))).alias("cohesion"))


def health(stability_: Column, cohesion_: Column, separation_: Column) -> Column:
    return 100.0 * (0.3 * stability_ + 0.3 * cohesion_ + 0.4 * separation_)


def actionability(stats: DataFrame) -> DataFrame:
    return stats.groupBy("segment").agg(F.least(100.0 * (F.least(F.max("n"), F.lit(1000)) / 1000.0 + F.avg("importance")) / 2.0, F.lit(100.0)).alias("actionability"))


def trait(mean: Column, median: Column, std: Column) -> Column:
    return F.when(mean > 1.2 * median, "High").when(mean < 0.8 * median, "Low").when(std > 0.5 * mean, "Variable")


def membership_confidence(own: Column, other: Column) -> Column:
    return F.when(other > 0, 1.0 / (1.0 + own / other)).otherwise(1.0)


def entropy(counts: DataFrame) -> DataFrame:
    """Shannon entropy in bits and Gini coefficient of ``n`` per segment; Gini is null for one category."""
    w = Window.partitionBy("segment")
    at = counts.withColumn("_t", F.sum("n").over(w)).withColumn("_k", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy("n")))
    p = F.col("n") / F.col("_t")
    gini = F.sum((2.0 * F.col("_i") - F.col("_k") - 1.0) * F.col("n"))
    k, t = F.max("_k"), F.max("_t")
    return at.groupBy("segment").agg(F.sum(-p * F.log2(p)).alias("shannon_entropy"), F.when(t <= 1, 0.0).when(k > 1, gini / ((k - 1.0) * t)).alias("gini_coefficient"))


def aging(tenure: DataFrame, churn: Column) -> DataFrame:
    """Tenure of (segment, days) and the stage of life that it and the churn rate give."""
    mean = F.avg("days")
    life = F.when((mean < 30) & (churn < 0.1), "emerging").when((mean < 180) & (churn < 0.15), "growth").when(churn < 0.2, "mature").otherwise("declining")
    found = tenure.groupBy("segment").agg(mean.alias("avg_member_tenure_days"), F.min("days").alias("newest_member_days_ago"), F.max("days").alias("oldest_member_days_ago"), life.alias("segment_lifespan_stage"))
    middle = quarters(tenure.select("segment", F.col("days").alias("x")), ["segment"]).select("segment", F.col("median").alias("median_member_tenure_days"))
    return same_keys(found, middle, ["segment"])


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, clamp(dot(a, b) / norms, -1.0, 1.0)).otherwise(0.0)


def differentiation(centroids: DataFrame, corrected: bool = False) -> DataFrame:
    """Per centroid (segment, c), the similarity to the others.

    As in the original semantics "nearest" is the smallest similarity;
    ``corrected`` takes the largest. Centroids are as few as segments.
    """
    pairs = centroids.alias("a").join(F.broadcast(centroids.alias("b")), F.col("a.segment") != F.col("b.segment"), "left")
    s = cosine(F.col("a.c"), F.col("b.c"))
    low, high = F.least(F.min(s), F.lit(1.0)), F.greatest(F.max(s), F.lit(0.0))
    near, far = (high, low) if corrected else (low, high)
    out = pairs.groupBy(F.col("a.segment").alias("segment")).agg(F.coalesce(near, F.lit(1.0)).alias("similarity_to_nearest"), F.coalesce(far, F.lit(0.0)).alias("similarity_to_farthest"))
    return out.withColumn("differentiation_score", 1.0 - F.col("similarity_to_nearest"))


def predictability(variance: Column, churn: Column) -> dict[str, Column]:
    return {"predictability_score": F.greatest(1.0 - 0.5 * variance - 0.5 * churn, F.lit(0.0)), "stability_trend": F.when(churn <= 0.05, "stable").when(churn > 0.15, "declining").otherwise("neutral")}


def segment_health(confidence: Column, predictability_: Column, differentiation_: Column, members: Column) -> dict[str, Column]:
    size = F.when((members > 100) & (members < 10_000), 80.0).when(members > 10, 60.0).otherwise(40.0)
    alerts = [(confidence < 0.5, "Low membership confidence"), (predictability_ < 0.5, "High member churn"), (differentiation_ < 0.3, "Not differentiated from other segments"), (members < 10, "Very small segment")]
    return {
        "health_score": confidence * 30.0 + predictability_ * 30.0 + differentiation_ * 20.0 + size / 100.0 * 20.0,
        "size_health": size,
        "trend": F.when((predictability_ > 0.7) & (confidence > 0.7), "improving").when((predictability_ < 0.4) | (confidence < 0.4), "declining").otherwise("stable"),
        "alerts": F.array_compact(F.array(*[F.when(c, t) for c, t in alerts])),
    }


def segment_stability(retention: Column, change: Column) -> dict[str, Column]:
    score = retention * F.greatest(1.0 - F.abs(change), F.lit(0.0))
    return {"stability_score": score, "trend": F.when(change > 0.1, "growing").when(change < -0.1, "shrinking").when(retention > 0.9, "stable").otherwise("volatile"), "risk_level": bands(score, [(">", 0.8, "low"), (">", 0.5, "medium")], "high")}


def decay(first: Column, last: Column, periods: Column, current: Column, corrected: bool = False) -> dict[str, Column]:
    """Decay from the first to the last size.

    The original half-life and extinction take the logarithm of the rate, and
    a base below one; ``corrected`` takes both by the share that is kept. Null
    stands for never.
    """
    rate = F.when((first > 0) & (periods > 0), 1.0 - F.pow(last / first, 1.0 / periods)).otherwise(0.0)
    falls = (rate > 0) & (rate < 1)
    half = F.lit(0.6931471805599453) / F.abs(F.ln(1.0 - rate) if corrected else F.ln(rate))
    gone = F.ln(current) / (F.abs(F.ln(1.0 - rate)) if corrected else F.ln(1.0 - rate))
    return {"decay_rate": rate, "is_decaying": rate > 0.05, "decay_status": bands(rate, [("<", 0.02, "healthy"), ("<", 0.1, "slow_decay")], "rapid_decay"), "half_life_periods": F.when(falls, half), "estimated_extinction_periods": F.when(falls & (current > 0), gone)}


def explained(importance: DataFrame) -> DataFrame:
    """The three strongest drivers and the next three of (segment, feature, importance, value, mean)."""
    w = Window.partitionBy("segment").orderBy(F.desc("importance"), "feature")
    at = importance.withColumn("rank", F.row_number().over(w)).where("rank <= 6")
    share = F.col("importance") / F.greatest(F.max("importance").over(Window.partitionBy("segment")), F.lit(0.001))
    first = F.col("rank") <= 3
    return at.select("segment", "feature", "rank", F.when(first, "primary").otherwise("secondary").alias("kind"), share.alias("weight"), F.when(F.col("value") > F.col("mean"), "high").otherwise("low").alias("direction"), F.least(F.when(first, share).otherwise(share * 0.7), F.lit(1.0)).alias("prevalence"))


def summaries(drivers: DataFrame) -> DataFrame:
    """A sentence per segment of ``explained`` rows: its strongest driver, or that it has none."""
    first = F.max_by(F.struct("feature", "direction", "weight", "prevalence"), -F.col("rank"))
    d = drivers.groupBy("segment").agg(first.alias("d")).select("segment", "d.*")
    side = F.when(F.col("direction") == "high", "elevated").otherwise("depressed")
    percent = lambda c: F.format_string("%d", c.cast("bigint"))
    text = F.concat(F.lit("Segment "), F.col("segment"), F.lit(" is primarily characterized by "), side, F.lit(" "), F.col("feature"), F.lit(" (importance: "), percent(F.bround(F.col("weight") * 100)), F.lit("%, "), percent(F.floor(F.col("prevalence") * 100)), F.lit(" of members affected)."))
    return d.select("segment", F.when(F.col("feature").isNull(), F.concat(F.lit("Segment "), F.col("segment"), F.lit(" has no primary drivers identified."))).otherwise(text).alias("summary"))


def shap_like(value: Column, base: Column) -> Column:
    return (value - base) * 0.1


def whole_profile(rows: DataFrame) -> DataFrame:
    """Per segment of long rows (segment, feature, x): size, health and its parts, actionability, traits and a description.

    The first feature by name is the one that the description tells of.
    """
    stats = statistics(rows)
    text = F.concat_ws(" ", trait(F.col("mean"), F.col("median"), F.col("std")), F.col("feature"))
    traits = F.transform(F.slice(F.array_sort(F.collect_list(F.when(trait(F.col("mean"), F.col("median"), F.col("std")).isNotNull(), F.struct("feature", text.alias("t"))))), 1, 3), lambda x: x["t"])
    per = stats.groupBy("segment").agg(F.max("n").alias("size"), traits.alias("_traits"), F.min_by("feature", "feature").alias("_f"), F.min_by("mean", "feature").alias("_m"))
    out = per.join(cohesion(stats), "segment").join(separation(rows), "segment", "left").join(actionability(stats), "segment")
    out = out.withColumn("separation", F.coalesce("separation", F.lit(0.0))).withColumn("stability", stability(F.col("size")))
    word = bands(F.col("size"), [("<", 50, "Small"), ("<", 200, "Medium"), ("<", 1000, "Large")], "Very large")
    return out.select(
        "segment",
        "size",
        "stability",
        "cohesion",
        "separation",
        clamp(health(F.col("stability"), F.col("cohesion"), F.col("separation")), 0.0, 100.0).alias("health_score"),
        "actionability",
        F.when(F.size("_traits") > 0, F.col("_traits")).otherwise(F.array(F.lit("Homogeneous"))).alias("characteristics"),
        F.format_string("%s segment of %d members with mean %s %.2f", word, F.col("size"), F.col("_f"), F.col("_m")).alias("description"),
    )


def business_metrics(profiles: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Share of each segment's size with the means over all segments, and the mean importance of each feature over the segments."""
    whole = Window.partitionBy()
    sizes = profiles.select("segment", ratio(F.col("size") * 100.0, F.sum("size").over(whole)).alias("size_percentage"), F.avg("actionability").over(whole).alias("segment_diversity"), F.avg("health_score").over(whole).alias("overall_health"))
    n = profiles.agg(F.count("*").alias("_k"))
    importance = stats.groupBy("feature").agg(F.sum("importance").alias("_i")).crossJoin(F.broadcast(n)).select("feature", (F.col("_i") / F.col("_k")).alias("importance"))  # one row
    return sizes, importance


def contributions(importance: DataFrame) -> DataFrame:
    """Top and bottom third of the features of (segment, member, feature, score), one to five each."""
    w = Window.partitionBy("segment", "member")
    at = importance.withColumn("_n", F.count("*").over(w)).withColumn("_d", F.row_number().over(w.orderBy(F.desc("score"), "feature"))).withColumn("_a", F.row_number().over(w.orderBy("score", F.desc("feature"))))
    most = F.least(F.greatest(F.floor(F.col("_n") / 3), F.lit(1)), F.lit(5))
    pick = lambda rank: F.transform(F.array_sort(F.collect_list(F.when(F.col(rank) <= most, F.struct(rank, "feature")))), lambda x: x["feature"])
    return at.groupBy("segment", "member").agg(pick("_d").alias("top_features"), pick("_a").alias("bottom_features"))
