"""Queries on drift between two times, segment profiles and segment intelligence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import drift, profiling
from tessella.plans.registry import query
from tessella.plans.segments_queries import CUSTOMERS_SQL, customers
from tessella.sources.tables import table

#: Line items shipped before and after this day are the two samples.
CUT = "1998-01-01"

FEATURES = ("l_quantity", "l_extendedprice", "l_discount")
U_SQL = "u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, (l_shipdate >= DATE '{CUT}')::INT AS side, {c} AS x FROM lineitem" for c in FEATURES) + ")"


def samples(spark, sf_dir):
    """Long form of the features: one scan, three rows a line item."""
    rows = table(spark, sf_dir, "lineitem")
    side = (F.col("l_shipdate") >= F.lit(CUT).cast("timestamp_ntz")).cast("int")
    return rows.select(side.alias("side"), *FEATURES).unpivot("side", list(FEATURES), "feature", "x").select("feature", "side", "x")


KS_SQL = f"""{U_SQL}, per AS (SELECT feature, x, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM u GROUP BY 1, 2),
  ks AS (SELECT feature, max(gap) AS drift_score FROM (SELECT feature, abs((sum(a) OVER w)::DOUBLE / (sum(a) OVER v) - (sum(b) OVER w)::DOUBLE / (sum(b) OVER v)) AS gap FROM per
    WINDOW w AS (PARTITION BY feature ORDER BY x ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY feature)) GROUP BY 1)"""
SEVERITY_SQL = "CASE WHEN drift_score < 0.1 THEN 'none' WHEN drift_score < 0.2 THEN 'low' WHEN drift_score < 0.35 THEN 'medium' WHEN drift_score < 0.5 THEN 'high' ELSE 'critical' END"


@query("drift_ks", f"WITH {KS_SQL} SELECT feature, round(drift_score, 9) AS drift_score, {SEVERITY_SQL} AS severity FROM ks")
def drift_ks(spark, sf_dir):
    return drift.kolmogorov_smirnov(samples(spark, sf_dir), ["feature"]).select("feature", F.round("drift_score", 9).alias("drift_score"), drift.severity(F.col("drift_score")).alias("severity"))


@query(
    "drift_hellinger",
    f"""WITH {U_SQL}, m AS (SELECT feature, avg(x) FILTER (side = 0) AS m0, avg(x) FILTER (side = 1) AS m1, greatest(var_pop(x) FILTER (side = 0), 1e-9) AS v0, greatest(var_pop(x) FILTER (side = 1), 1e-9) AS v1 FROM u GROUP BY 1),
    h AS (SELECT feature, (m0 - m1) * (m0 - m1) / (4 * (v0 + v1)) + 0.5::DOUBLE * ln((v0 + v1) / (2 * sqrt(v0 * v1))) AS d FROM m) SELECT feature, round(least(sqrt(greatest(1 - exp(-d), 0)), 1), 6) AS drift_score FROM h""",
)
def drift_hellinger(spark, sf_dir):
    return drift.hellinger(samples(spark, sf_dir), ["feature"]).withColumn("drift_score", F.round("drift_score", 6))


@query(
    "drift_chi_square",
    f"""WITH per AS (SELECT o_orderpriority AS category, count(*) FILTER (o_orderdate < DATE '{CUT}') AS a, count(*) FILTER (o_orderdate >= DATE '{CUT}') AS b FROM orders GROUP BY 1),
    e AS (SELECT *, a::DOUBLE / sum(a) OVER () * sum(b) OVER () AS ex FROM per) SELECT 'o_orderpriority' AS feature, round(avg((b - ex) * (b - ex) / ex), 9) AS drift_score FROM e WHERE a > 0""",
)
def drift_chi_square(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.lit("o_orderpriority").alias("feature"), (F.col("o_orderdate") >= F.lit(CUT).cast("timestamp_ntz")).cast("int").alias("side"), F.col("o_orderpriority").alias("category"))
    return drift.chi_square(rows, ["feature"]).withColumn("drift_score", F.round("drift_score", 9))


@query(
    "drift_alerts",
    f"WITH {KS_SQL} SELECT feature, printf('Feature ''%s'' drift detected: %.4f (%s)', feature, drift_score, {SEVERITY_SQL}) AS message FROM ks",
)
def drift_alerts(spark, sf_dir):
    return drift.kolmogorov_smirnov(samples(spark, sf_dir), ["feature"]).select("feature", drift.alert_text(F.col("feature"), F.col("drift_score")).alias("message"))


STATS_SQL = """r AS (SELECT feature, side, x, row_number() OVER (PARTITION BY feature, side ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY feature, side) AS n, avg(x) OVER (PARTITION BY feature, side) AS m FROM u)"""


@query(
    "distribution_stats",
    f"""WITH {U_SQL}, {STATS_SQL} SELECT feature, side, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std_dev, min(x) AS min, max(x) AS max, round(median(x), 6) AS median, max(x) FILTER (i = floor(n * 0.25::DOUBLE)) AS p25,
    max(x) FILTER (i = floor(n * 0.75::DOUBLE)) AS p75, round(avg((x - m) ** 3) / pow(avg((x - m) * (x - m)), 1.5::DOUBLE), 6) AS skewness, round(avg((x - m) ** 4) / pow(avg((x - m) * (x - m)), 2::DOUBLE) - 3, 6) AS kurtosis FROM r GROUP BY 1, 2""",
)
def distribution_stats(spark, sf_dir):
    return drift.statistics(samples(spark, sf_dir), ["feature", "side"]).withColumns({c: F.round(c, 6) for c in ("mean", "std_dev", "median", "skewness", "kurtosis")})


@query(
    "composition_change",
    f"""WITH s AS (SELECT c_mktsegment AS segment, count(*) FILTER (o_orderdate < DATE '{CUT}') AS p, count(*) FILTER (o_orderdate >= DATE '{CUT}') AS c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
    SELECT segment AS segment_name, p AS previous_size, c AS current_size, round((c - p) * 100.0::DOUBLE / (SELECT sum(p) FROM s), 9) AS size_change_percent, round(greatest(p - c, 0)::DOUBLE / p, 9) AS churn_rate, round(greatest(c - p, 0)::DOUBLE / p, 9) AS growth_rate FROM s""",
)
def composition_change(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey")
    later = F.col("o_orderdate") >= F.lit(CUT).cast("timestamp_ntz")
    size = lambda keep: rows.where(keep).groupBy("segment").agg(F.count("*").alias("size"))
    return drift.composition_change(size(~later), size(later)).withColumns({c: F.round(c, 9) for c in ("size_change_percent", "churn_rate", "growth_rate")})


LONG_SQL = f"{CUSTOMERS_SQL}, long AS (" + " UNION ALL ".join(f"SELECT segment, '{c}' AS feature, {c} AS x FROM customers" for c in ("recency", "frequency", "monetary")) + ")"


def long_rows(spark, sf_dir):
    return customers(spark, sf_dir).select("segment", "recency", "frequency", "monetary").unpivot("segment", ["recency", "frequency", "monetary"], "feature", "x")


PS_SQL = f"""{LONG_SQL}, lr AS (SELECT *, row_number() OVER (PARTITION BY segment, feature ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY segment, feature) AS c FROM long),
  ps AS (SELECT segment, feature, count(*) AS n, avg(x) AS mean, median(x) AS median, stddev_pop(x) AS std, min(x) AS mn, max(x) AS mx, max(x) FILTER (i = c // 4) AS q25, max(x) FILTER (i = c * 3 // 4) AS q75 FROM lr GROUP BY 1, 2)"""


@query("profile_statistics", f"WITH {PS_SQL} SELECT segment, feature, n, round(mean, 4) AS mean, round(median, 4) AS median, round(std, 4) AS std, round(mn, 4) AS min, round(mx, 4) AS max, round(q25, 4) AS q25, round(q75, 4) AS q75, round(std / (mx - mn + 1e-10), 6) AS importance FROM ps")
def profile_statistics(spark, sf_dir):
    return profiling.statistics(long_rows(spark, sf_dir)).withColumns({**{c: F.round(c, 4) for c in ("mean", "median", "std", "min", "max", "q25", "q75")}, "importance": F.round("importance", 6)})


@query("profile_traits", f"WITH {PS_SQL} SELECT segment, feature, CASE WHEN mean > 1.2::DOUBLE * median THEN 'High' WHEN mean < 0.8::DOUBLE * median THEN 'Low' WHEN std > 0.5::DOUBLE * mean THEN 'Variable' END AS trait FROM ps")
def profile_traits(spark, sf_dir):
    s = profiling.statistics(long_rows(spark, sf_dir))
    return s.select("segment", "feature", profiling.trait(F.col("mean"), F.col("median"), F.col("std")).alias("trait"))


@query(
    "profile_separation",
    f"""WITH {LONG_SQL}, t AS (SELECT feature, count(*) AS nn, sum(x) AS ss, sum(x * x) AS qq FROM long GROUP BY 1), o AS (SELECT segment, feature, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM long GROUP BY 1, 2),
    m AS (SELECT segment, s / n AS m1, (ss - s) / (nn - n) AS m2, sqrt(greatest(q / n - (s / n) * (s / n), 0)) AS d1, sqrt(greatest((qq - q) / (nn - n) - ((ss - s) / (nn - n)) * ((ss - s) / (nn - n)), 0)) AS d2 FROM o JOIN t USING (feature))
    SELECT segment, round(avg(CASE WHEN (d1 + d2) / 2 < 1e-10 THEN 0 ELSE least(abs(m1 - m2) / ((d1 + d2) / 2), 2) / 2 END), 6) AS separation FROM m GROUP BY 1""",
)
def profile_separation(spark, sf_dir):
    return profiling.separation(long_rows(spark, sf_dir)).withColumn("separation", F.round("separation", 6))


@query(
    "profile_purity",
    f"""WITH {CUSTOMERS_SQL}, p AS (SELECT segment, c_mktsegment AS label, count(*) AS n FROM customers JOIN customer ON c_custkey = customer_id GROUP BY 1, 2) SELECT segment, round(max(n)::DOUBLE / sum(n), 9) AS purity FROM p GROUP BY 1""",
)
def profile_purity(spark, sf_dir):
    label = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("label"))
    return profiling.purity(customers(spark, sf_dir).join(label, "customer_id")).withColumn("purity", F.round("purity", 9))


@query(
    "profile_actionability",
    f"""WITH {PS_SQL}, i AS (SELECT segment, max(n) AS n, avg(std / (mx - mn + 1e-10)) AS imp, avg(CASE WHEN abs(mean) > 1e-10 THEN std / abs(mean) END) AS cv FROM ps GROUP BY 1)
    SELECT segment, round(least(100 * (least(n, 1000) / 1000.0::DOUBLE + imp) / 2, 100), 6) AS actionability, round(1 - least(coalesce(cv, 1) / 2, 1), 6) AS cohesion FROM i""",
)
def profile_actionability(spark, sf_dir):
    s = profiling.statistics(long_rows(spark, sf_dir))
    return profiling.actionability(s).join(profiling.cohesion(s), "segment").select("segment", F.round("actionability", 6).alias("actionability"), F.round("cohesion", 6).alias("cohesion"))


@query(
    "segment_entropy",
    """WITH p AS (SELECT c_nationkey AS segment, c_mktsegment AS k, count(*) AS n FROM customer GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER w AS t, count(*) OVER w AS kk, row_number() OVER (PARTITION BY segment ORDER BY n) AS i FROM p WINDOW w AS (PARTITION BY segment))
    SELECT segment, round(sum(-(n::DOUBLE / t) * log2(n::DOUBLE / t)), 6) AS shannon_entropy, round(CASE WHEN max(t) <= 1 THEN 0 WHEN max(kk) > 1 THEN sum((2 * i - kk - 1) * n) / ((max(kk) - 1) * max(t))::DOUBLE END, 9) AS gini_coefficient FROM r GROUP BY 1""",
)
def segment_entropy(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("segment"), "c_mktsegment").agg(F.count("*").alias("n"))
    return profiling.entropy(counts).withColumns({"shannon_entropy": F.round("shannon_entropy", 6), "gini_coefficient": F.round("gini_coefficient", 9)})


@query(
    "segment_aging",
    """WITH t AS (SELECT c_mktsegment AS segment, epoch(TIMESTAMP '2001-08-02' - min(o_orderdate)) / 86400 AS days FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, o_custkey)
    SELECT segment, round(avg(days), 6) AS avg_member_tenure_days, round(median(days), 6) AS median_member_tenure_days, round(min(days), 6) AS newest_member_days_ago, round(max(days), 6) AS oldest_member_days_ago,
    CASE WHEN avg(days) < 30 THEN 'emerging' WHEN avg(days) < 180 THEN 'growth' ELSE 'mature' END AS segment_lifespan_stage FROM t GROUP BY 1""",
)
def segment_aging(spark, sf_dir):
    from tessella.functions.columns import epoch

    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(epoch(F.col("o_orderdate"))).alias("t"))
    rows = first.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), "c_custkey")
    days = (F.lit("2001-08-02").cast("timestamp").cast("bigint") - F.col("t")) / 86_400.0
    out = profiling.aging(rows.withColumn("days", days), F.lit(0.05))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith(("days", "ago"))})


CENTROIDS_SQL = f"{CUSTOMERS_SQL}, cen AS (SELECT segment, [avg(recency_score), avg(frequency_score), avg(monetary_score)]::DOUBLE[] AS c FROM customers GROUP BY 1)"


def centroids(spark, sf_dir):
    return customers(spark, sf_dir).groupBy("segment").agg(F.array(F.avg("recency_score"), F.avg("frequency_score"), F.avg("monetary_score")).alias("c"))


@query(
    "segment_differentiation",
    f"""WITH {CENTROIDS_SQL}, s AS (SELECT a.segment, list_cosine_similarity(a.c, b.c) AS s FROM cen a JOIN cen b ON a.segment <> b.segment)
    SELECT segment, round(least(min(s), 1), 8) AS similarity_to_nearest, round(greatest(max(s), 0), 8) AS similarity_to_farthest, round(1 - least(min(s), 1), 8) AS differentiation_score FROM s GROUP BY 1""",
)
def segment_differentiation(spark, sf_dir):
    out = profiling.differentiation(centroids(spark, sf_dir))
    return out.select("segment", *[F.round(c, 8).alias(c) for c in ("similarity_to_nearest", "similarity_to_farthest", "differentiation_score")])


@query(
    "segment_confidence",
    f"""WITH {CENTROIDS_SQL}, d AS (SELECT customer_id, t.segment, cen.segment AS other, sqrt((recency_score - c[1])**2 + (frequency_score - c[2])**2 + (monetary_score - c[3])**2) AS d FROM customers t, cen),
    g AS (SELECT customer_id, segment, min(d) FILTER (other = segment) AS own, min(d) FILTER (other <> segment) AS near FROM d GROUP BY 1, 2)
    SELECT customer_id, segment, round(CASE WHEN near > 0 THEN 1 / (1 + own / near) ELSE 1 END, 6) AS confidence_score FROM g""",
)
def segment_confidence(spark, sf_dir):
    """Each customer against the few centroids, gathered into one array."""
    rows = customers(spark, sf_dir)
    all_ = centroids(spark, sf_dir).agg(F.collect_list(F.struct("segment", "c")).alias("all"))  # thirteen at most
    s = [F.col(c) for c in ("recency_score", "frequency_score", "monetary_score")]
    gap = lambda c: F.sqrt(sum((F.pow(s[i] - c[i], 2.0) for i in range(1, 3)), F.pow(s[0] - c[0], 2.0)))
    far = rows.crossJoin(F.broadcast(all_)).withColumn("far", F.transform("all", lambda x: F.struct(x["segment"].alias("segment"), gap(x["c"]).alias("d"))))
    own = F.array_min(F.transform(F.filter("far", lambda x: x["segment"] == F.col("segment")), lambda x: x["d"]))
    other = F.array_min(F.transform(F.filter("far", lambda x: x["segment"] != F.col("segment")), lambda x: x["d"]))
    return far.select("customer_id", "segment", F.round(profiling.membership_confidence(own, other), 6).alias("confidence_score"))


H_SQL = "h AS (SELECT c_mktsegment AS segment, count(DISTINCT o_custkey) FILTER (year(o_orderdate) = 1997) AS a, count(DISTINCT o_custkey) FILTER (year(o_orderdate) = 1998) AS b FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)"


def halves(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey")
    in_ = lambda y: F.countDistinct(F.when(F.year("o_orderdate") == y, F.col("o_custkey")))
    return rows.groupBy("segment").agg(in_(1997).alias("a"), in_(1998).alias("b"))


@query(
    "segment_stability",
    f"""WITH {H_SQL}, s AS (SELECT segment, least(b::DOUBLE / a, 1) AS r, (b - a)::DOUBLE / a AS d FROM h) SELECT segment, round(r * greatest(1 - abs(d), 0), 9) AS stability_score,
    CASE WHEN d > 0.1 THEN 'growing' WHEN d < -0.1 THEN 'shrinking' WHEN r > 0.9 THEN 'stable' ELSE 'volatile' END AS trend, CASE WHEN r * greatest(1 - abs(d), 0) > 0.8 THEN 'low' WHEN r * greatest(1 - abs(d), 0) > 0.5 THEN 'medium' ELSE 'high' END AS risk_level FROM s""",
)
def segment_stability(spark, sf_dir):
    cols = profiling.segment_stability(F.least(F.col("b") / F.col("a"), F.lit(1.0)), (F.col("b") - F.col("a")) / F.col("a"))
    return halves(spark, sf_dir).select("segment", *[(F.round(c, 9) if n == "stability_score" else c).alias(n) for n, c in cols.items()])


@query(
    "segment_decay",
    f"""WITH {H_SQL}, d AS (SELECT segment, b, 1 - b::DOUBLE / a AS r FROM h) SELECT segment, round(r, 9) AS decay_rate, r > 0.05 AS is_decaying, CASE WHEN r < 0.02 THEN 'healthy' WHEN r < 0.1 THEN 'slow_decay' ELSE 'rapid_decay' END AS decay_status,
    CASE WHEN r > 0 AND r < 1 THEN round(ln(2) / abs(ln(r)), 6) END AS half_life_periods, CASE WHEN r > 0 AND r < 1 THEN round(ln(b) / ln(1 - r), 4) END AS estimated_extinction_periods FROM d""",
)
def segment_decay(spark, sf_dir):
    cols = profiling.decay(F.col("a").cast("double"), F.col("b").cast("double"), F.lit(1.0), F.col("b").cast("double"))
    digits = {"decay_rate": 9, "half_life_periods": 6, "estimated_extinction_periods": 4}
    return halves(spark, sf_dir).select("segment", *[(F.round(c, digits[n]) if n in digits else c).alias(n) for n, c in cols.items()])


@query(
    "segment_health",
    f"""WITH {H_SQL}, s AS (SELECT segment, b AS n, 0.6::DOUBLE AS conf, greatest(1 - 0.5 * abs(b - a)::DOUBLE / a, 0) AS pred, 0.25::DOUBLE AS diff FROM h),
    z AS (SELECT *, CASE WHEN n > 100 AND n < 10000 THEN 80.0 WHEN n > 10 THEN 60.0 ELSE 40.0 END::DOUBLE AS size_health FROM s)
    SELECT segment, round(conf * 30 + pred * 30 + diff * 20 + size_health / 100 * 20, 6) AS health_score, size_health, CASE WHEN pred > 0.7 AND conf > 0.7 THEN 'improving' WHEN pred < 0.4 OR conf < 0.4 THEN 'declining' ELSE 'stable' END AS trend,
    list_filter([CASE WHEN conf < 0.5 THEN 'Low membership confidence' END, CASE WHEN pred < 0.5 THEN 'High member churn' END, CASE WHEN diff < 0.3 THEN 'Not differentiated from other segments' END, CASE WHEN n < 10 THEN 'Very small segment' END], lambda x: x IS NOT NULL) AS alerts FROM z""",
)
def segment_health(spark, sf_dir):
    churn = F.abs(F.col("b") - F.col("a")) / F.col("a")
    pred = profiling.predictability(F.lit(0.0), churn)["predictability_score"]
    cols = profiling.segment_health(F.lit(0.6), pred, F.lit(0.25), F.col("b"))
    return halves(spark, sf_dir).select("segment", *[(F.round(c, 6) if n == "health_score" else c).alias(n) for n, c in cols.items()])


@query(
    "profile_health",
    f"""WITH {PS_SQL}, i AS (SELECT segment, max(n) AS n, avg(CASE WHEN abs(mean) > 1e-10 THEN std / abs(mean) END) AS cv FROM ps GROUP BY 1) SELECT segment, n AS size, round(1 / (1 + exp(-n / 100.0::DOUBLE)), 8) AS stability, round(1 - least(coalesce(cv, 1) / 2, 1), 6) AS cohesion FROM i""",
)
def profile_health(spark, sf_dir):
    out = profiling.whole_profile(long_rows(spark, sf_dir))
    return out.select("segment", "size", F.round("stability", 8).alias("stability"), F.round("cohesion", 6).alias("cohesion"))


@query("profile_importance", f"WITH {PS_SQL} SELECT feature, round(sum(std / (mx - mn + 1e-10)) / (SELECT count(DISTINCT segment) FROM ps), 6) AS importance FROM ps GROUP BY 1")
def profile_importance(spark, sf_dir):
    rows = long_rows(spark, sf_dir)
    return profiling.business_metrics(profiling.whole_profile(rows), profiling.statistics(rows))[1].withColumn("importance", F.round("importance", 6))


@query(
    "segment_explained",
    f"""WITH {PS_SQL}, g AS (SELECT feature, avg(x) AS gm FROM long GROUP BY 1), r AS (SELECT segment, feature, round(std / (mx - mn + 1e-10), 6) AS imp, mean, gm FROM ps JOIN g USING (feature)), k AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY imp DESC, feature)::INT AS rank, max(imp) OVER (PARTITION BY segment) AS top FROM r)
    SELECT segment, feature, rank, 'primary' AS kind, round(imp / greatest(top, 0.001), 6) AS weight, CASE WHEN mean > gm THEN 'high' ELSE 'low' END AS direction FROM k""",
)
def segment_explained(spark, sf_dir):
    rows = long_rows(spark, sf_dir)
    means = rows.groupBy("feature").agg(F.avg("x").alias("mean"))
    stats = profiling.statistics(rows).select("segment", "feature", F.round("importance", 6).alias("importance"), F.col("mean").alias("value"))
    return profiling.explained(stats.join(means, "feature")).select("segment", "feature", "rank", "kind", F.round("weight", 6).alias("weight"), "direction")


@query(
    "segment_contributions",
    f"""WITH {PS_SQL}, r AS (SELECT segment, feature, round(std / (mx - mn + 1e-10), 6) AS s FROM ps) SELECT segment, list(feature ORDER BY s DESC, feature)[1:1] AS top_features, list(feature ORDER BY s, feature DESC)[1:1] AS bottom_features FROM r GROUP BY 1""",
)
def segment_contributions(spark, sf_dir):
    stats = profiling.statistics(long_rows(spark, sf_dir)).select("segment", F.lit("all").alias("member"), "feature", F.round("importance", 6).alias("score"))
    return profiling.contributions(stats).drop("member")


def _bins_sql(bins: int) -> str:
    """Counts a, b of both sides per feature and bin, as ``c``; bins share side 0 equally."""
    return f"""{U_SQL}, sorted AS (SELECT feature, list(x ORDER BY x) FILTER (side = 0) AS xs FROM u GROUP BY 1),
    edges AS (SELECT feature, list_distinct(list_transform(range(1, {bins}), lambda i: xs[len(xs) * i // {bins} + 1])) AS es FROM sorted),
    c AS (SELECT feature, len(list_filter(es, lambda e: e <= x)) AS bin, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM u JOIN edges USING (feature) GROUP BY 1, 2)"""


@query(
    "drift_kl",
    f"""WITH {_bins_sql(10)}, p AS (SELECT feature, (a + 0.5::DOUBLE) / (sum(a) OVER w + 0.5::DOUBLE * count(*) OVER w) AS p, (b + 0.5::DOUBLE) / (sum(b) OVER w + 0.5::DOUBLE * count(*) OVER w) AS q FROM c WINDOW w AS (PARTITION BY feature)),
    d AS (SELECT feature, sum(p * ln(p / q)) AS d FROM p GROUP BY 1) SELECT feature, round(d, 9) AS divergence, round(sqrt(1 - exp(-d)), 9) AS drift_score FROM d""",
)
def drift_kl(spark, sf_dir):
    return drift.kullback_leibler(samples(spark, sf_dir), ["feature"]).select("feature", F.round("divergence", 9).alias("divergence"), F.round("drift_score", 9).alias("drift_score"))


@query(
    "drift_chi_square_numbers",
    f"""WITH {_bins_sql(11)}, t AS (SELECT *, sum(a) OVER w AS na, sum(b) OVER w AS nb, count(*) OVER w AS k FROM c WINDOW w AS (PARTITION BY feature)),
    s AS (SELECT feature, any_value(k) AS k, any_value(na + nb) AS n, sum(pow(a - (a + b) * na::DOUBLE / (na + nb), 2) / ((a + b) * na::DOUBLE / (na + nb)) + pow(b - (a + b) * nb::DOUBLE / (na + nb), 2) / ((a + b) * nb::DOUBLE / (na + nb))) AS s FROM t GROUP BY 1)
    SELECT feature, round(s, 6) AS statistic, (k - 1)::INT AS freedom, CASE WHEN k = 11 THEN round(exp(-s / 2) * (1 + s / 2 + pow(s / 2, 2) / 2 + pow(s / 2, 3) / 6 + pow(s / 2, 4) / 24), 9) ELSE -1 END AS p_value, round(sqrt(s / n), 9) AS drift_score FROM s""",
)
def drift_chi_square_numbers(spark, sf_dir):
    """Ten degrees of freedom have a closed form, which the SQL takes; features with fewer bins have no p-value there."""
    found = drift.chi_square_numbers(samples(spark, sf_dir), ["feature"])
    return found.select("feature", F.round("statistic", 6).alias("statistic"), "freedom", F.when(F.col("freedom") == 10, F.round("p_value", 9)).otherwise(-1.0).alias("p_value"), F.round("drift_score", 9).alias("drift_score"))
