"""Queries on churn, lifetime value and short forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.columns import clamp, epoch, whole_days
from tessella.operators import value
from tessella.plans.registry import query
from tessella.plans.rfm_queries import AS_OF
from tessella.sources.tables import table

#: Customers with what the scores need; engagement is the frequency against 25 orders.
C_SQL = f"""c AS (
  SELECT o_custkey AS customer_id, sum(o_totalprice) AS spent, count(*) AS purchases,
    CAST(trunc((epoch(TIMESTAMP '{AS_OF}') - epoch(max(o_orderdate))) / 86400) AS BIGINT) AS recency,
    CAST(trunc((epoch(TIMESTAMP '{AS_OF}') - epoch(min(o_orderdate))) / 86400) AS BIGINT) AS tenure,
    least(count(*) / 25.0::DOUBLE, 1) AS engagement
  FROM orders GROUP BY 1)"""


def customers(spark, sf_dir) -> DataFrame:
    now = F.lit(AS_OF).cast("timestamp").cast("bigint")
    ts = epoch(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.sum("o_totalprice").alias("spent"), F.count("*").alias("purchases"), whole_days(now - F.max(ts)).alias("recency"), whole_days(now - F.min(ts)).alias("tenure"), F.least(F.count("*") / 25.0, F.lit(1.0)).alias("engagement")
    )


def _d(name: str):
    return F.col(name).cast("double")


LOGISTIC_SQL = """1.0::DOUBLE / (1.0::DOUBLE + exp(-(-0.5::DOUBLE + 0.35::DOUBLE * least(recency / 90.0::DOUBLE, 1) - 0.4::DOUBLE * least(purchases / 20.0::DOUBLE, 1)
  - 0.3::DOUBLE * least(spent / 100 / 5000.0::DOUBLE, 1) - 0.15::DOUBLE * least(tenure / 1000.0::DOUBLE, 1) - 0.25::DOUBLE * least(engagement, 1))))"""


def _logistic():
    # Order totals of the test tables are a hundred times those the score was made for.
    return value.churn_logistic(_d("recency"), _d("purchases"), F.col("spent") / 100.0, _d("tenure"), F.col("engagement"), F.lit(0.0))


@query("churn_logistic", f"WITH {C_SQL} SELECT customer_id, round({LOGISTIC_SQL}, 9) AS churn_probability FROM c")
def churn_logistic(spark, sf_dir):
    return customers(spark, sf_dir).select("customer_id", F.round(_logistic(), 9).alias("churn_probability"))


@query(
    "churn_ensemble",
    f"""WITH {C_SQL} SELECT customer_id, round((CASE WHEN engagement < 0.3 THEN 0.75 WHEN engagement < 0.6 THEN 0.5 ELSE 0.2 END::DOUBLE
    + CASE WHEN recency > 60 THEN 0.8 WHEN recency > 30 THEN 0.5 ELSE 0.15 END::DOUBLE + CASE WHEN spent < 100 THEN 0.7 WHEN spent < 500 THEN 0.4 ELSE 0.15 END::DOUBLE
    + CASE WHEN purchases < 2 THEN 0.65 WHEN purchases < 5 THEN 0.35 ELSE 0.1 END::DOUBLE + CASE WHEN tenure < 90 THEN 0.6 WHEN tenure < 365 THEN 0.3 ELSE 0.1 END::DOUBLE) / 5, 9) AS churn_probability FROM c""",
)
def churn_ensemble(spark, sf_dir):
    p = value.churn_ensemble(_d("recency"), _d("purchases"), F.col("spent"), _d("tenure"), F.col("engagement"))
    return customers(spark, sf_dir).select("customer_id", F.round(p, 9).alias("churn_probability"))


LEVEL_SQL = "CASE WHEN p < 0.1 THEN 'very_low' WHEN p < 0.25 THEN 'low' WHEN p < 0.5 THEN 'medium' WHEN p < 0.75 THEN 'high' ELSE 'critical' END"
P_SQL = f"{C_SQL}, s AS (SELECT *, {LOGISTIC_SQL} AS p FROM c)"


def scored(spark, sf_dir) -> DataFrame:
    return customers(spark, sf_dir).withColumn("p", _logistic())


@query(
    "churn_predictions",
    f"""WITH {P_SQL} SELECT customer_id, round(p, 9) AS churn_probability, {LEVEL_SQL} AS risk_level,
    greatest(90 - trunc(90 * p)::INT + trunc(recency / 30.0::DOUBLE)::INT, 1)::INT AS days_until_churn_estimate,
    CASE WHEN recency > 60 THEN 0.45 ELSE 0.35 END::DOUBLE AS importance_recency, CASE WHEN purchases < 2 THEN 0.35 ELSE 0.25 END::DOUBLE AS importance_frequency,
    CASE WHEN engagement < 0.3 THEN 'email_campaign' WHEN spent < 100 THEN 'discount' ELSE 'vip_support' END AS action_type,
    CASE {LEVEL_SQL} WHEN 'critical' THEN '20% discount + priority support' WHEN 'high' THEN '15% discount' WHEN 'medium' THEN '10% discount' END AS recommended_offer FROM s""",
)
def churn_predictions(spark, sf_dir):
    action = value.retention_action(F.col("p"), F.col("spent"), F.col("engagement"))
    weights = value.importances(_d("recency"), _d("purchases"), F.col("spent"))
    return scored(spark, sf_dir).withColumn("a", action).withColumn("w", weights).select(
        "customer_id", F.round("p", 9).alias("churn_probability"), value.risk_level(F.col("p")).alias("risk_level"), value.days_until_churn(F.col("p"), _d("recency")).alias("days_until_churn_estimate"),
        F.col("w.recency").alias("importance_recency"), F.col("w.frequency").alias("importance_frequency"), "a.action_type", "a.recommended_offer",
    )


@query(
    "churn_cohort_summary",
    f"""WITH {P_SQL} SELECT c_mktsegment AS cohort, count(*) AS customer_count, round(avg(p), 8) AS avg_churn_probability, count(*) FILTER (p >= 0.75) AS critical_churn_count,
    count(*) FILTER (p >= 0.5 AND p < 0.75) AS high_churn_count, round(1 - avg(p), 8) AS retention_potential, count(*) FILTER (p >= 0.5) * 500.0::DOUBLE AS estimated_ltv_at_risk
    FROM s JOIN customer ON c_custkey = customer_id GROUP BY 1""",
)
def churn_cohort_summary(spark, sf_dir):
    cohorts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("cohort"))
    out = value.churn_summary(scored(spark, sf_dir).join(cohorts, "customer_id"), "cohort")
    return out.withColumns({c: F.round(c, 8) for c in ("avg_churn_probability", "retention_potential")})


def _labelled(spark, sf_dir) -> DataFrame:
    """Whether a customer has been away for over 90 days, against the ensemble-like score."""
    return scored(spark, sf_dir).select((F.col("recency") > 90).alias("actual"), F.round("p", 3).alias("p"))


L_SQL = f"{P_SQL}, l AS (SELECT recency > 90 AS actual, round(p, 3) AS p FROM s)"


@query(
    "model_confusion",
    f"""WITH {L_SQL}, m AS (SELECT count(*) AS training_samples, count(*) FILTER (actual AND p > 0.5) AS tp, count(*) FILTER (NOT actual AND p > 0.5) AS fp,
    count(*) FILTER (actual AND NOT p > 0.5) AS fn, count(*) FILTER (NOT actual AND NOT p > 0.5) AS tn FROM l), r AS (SELECT *, (tp + tn)::DOUBLE / training_samples AS accuracy,
    CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall FROM m)
    SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1_score FROM r""",
)
def model_confusion(spark, sf_dir):
    return value.confusion(_labelled(spark, sf_dir))


@query(
    "model_auc",
    f"""WITH {L_SQL}, per AS (SELECT p, count(*) FILTER (actual) AS pos, count(*) FILTER (NOT actual) AS neg FROM l GROUP BY 1),
    a AS (SELECT pos, neg, neg * (coalesce(sum(pos) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + pos / 2.0::DOUBLE) AS part FROM per)
    SELECT round(sum(part) / (sum(pos)::DOUBLE * sum(neg)), 9) AS auc_roc FROM a""",
)
def model_auc(spark, sf_dir):
    return value.auc_roc(_labelled(spark, sf_dir)).select(F.round("auc_roc", 9).alias("auc_roc"))


@query(
    "clv_simple",
    f"""WITH {C_SQL}, f AS (SELECT *, spent / purchases AS o, purchases * 365.0::DOUBLE / tenure AS y FROM c)
    SELECT customer_id, round(spent, 2) AS historical_value, round(o * y, 2) AS annual_value, round(o * y * 730 / 365, 2) AS predicted_ltv, round(o * y * 3 * 0.85::DOUBLE, 2) AS predicted_ltv_3yr,
    round(o * y * 5 * 0.7::DOUBLE, 2) AS predicted_ltv_5yr, round(CASE WHEN y < 1 THEN 0.25 WHEN y < 3 THEN 0.15 WHEN y < 6 THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN o < 100 THEN 0.15 WHEN o < 500 THEN 0.08 ELSE 0 END::DOUBLE, 6) AS churn_probability,
    0.75::DOUBLE AS confidence_score FROM f""",
)
def clv_simple(spark, sf_dir):
    cols = value.simple_ltv(F.col("spent"), F.col("purchases"), F.col("tenure"), F.lit(730.0))
    digits = {"churn_probability": 6, "confidence_score": 6}
    return customers(spark, sf_dir).select("customer_id", *[F.round(c, digits.get(n, 2)).alias(n) for n, c in cols.items()])


@query(
    "clv_probabilistic",
    f"""WITH {P_SQL}, f AS (SELECT *, spent / purchases * (purchases * 365.0::DOUBLE / tenure) AS annual, greatest(least(least(purchases, 15) / 15.0::DOUBLE, 1), 0.5) AS rf,
    CASE WHEN recency < 30 THEN 1.0 WHEN recency < 90 THEN 0.85 WHEN recency < 180 THEN 0.65 ELSE 0.4 END::DOUBLE AS rr FROM s), b AS (SELECT *, annual * 3 * rf * rr AS base FROM f)
    SELECT customer_id, round(base * (1 - p), 2) AS predicted_ltv, round(base * pow(1 - p, 3), 2) AS predicted_ltv_3yr, round(base * pow(1 - p, 5), 2) AS predicted_ltv_5yr, round(least(rf * rr, 0.95::DOUBLE), 6) AS confidence_score FROM b""",
)
def clv_probabilistic(spark, sf_dir):
    cols = value.probabilistic_ltv(F.col("spent"), F.col("purchases"), F.col("tenure"), F.col("recency"), F.least(_d("purchases"), F.lit(15.0)), F.col("p"))
    return scored(spark, sf_dir).select("customer_id", *[F.round(c, 6 if n == "confidence_score" else 2).alias(n) for n, c in cols.items()])


@query(
    "clv_churn_score",
    f"""WITH {C_SQL}, f AS (SELECT *, (CASE WHEN recency < 30 THEN 0.05 WHEN recency < 90 THEN 0.15 WHEN recency < 180 THEN 0.35 ELSE 0.65 END::DOUBLE
    + CASE WHEN purchases < 1 THEN 0.25 WHEN purchases < 3 THEN 0.15 WHEN purchases < 6 THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN spent < 100 THEN 0.15 WHEN spent < 500 THEN 0.08 ELSE 0 END::DOUBLE
    + CASE WHEN tenure < 90 THEN 0.2 WHEN tenure < 365 THEN 0.1 ELSE 0 END::DOUBLE) / 2 AS p FROM c)
    SELECT customer_id, round(p, 6) AS churn_probability, CASE WHEN p > 0.65 THEN 'critical' WHEN p > 0.45 THEN 'high' WHEN p > 0.25 THEN 'medium' ELSE 'low' END AS risk_level,
    CASE WHEN p > 0.3 THEN recency + 30 END AS days_until_churn, round(1 - p, 6) AS retention_score FROM f""",
)
def clv_churn_score(spark, sf_dir):
    cols = value.churn_score(F.col("recency"), _d("purchases"), F.col("spent"), F.col("tenure"))
    return customers(spark, sf_dir).select("customer_id", *[(F.round(c, 6) if n in ("churn_probability", "retention_score") else c).alias(n) for n, c in cols.items()])


@query(
    "revenue_projection",
    f"""WITH {P_SQL}, f AS (SELECT *, spent / greatest(tenure / 30.0::DOUBLE, 1) AS monthly, least(greatest((engagement - 0.5) * 2, -1), 1) * 0.15::DOUBLE AS g FROM s),
    t AS (SELECT *, CASE WHEN abs(g) < 0.01 THEN monthly * 12 ELSE monthly * (pow(1 + g, 12.0::DOUBLE) - 1) / g END AS total FROM f), a AS (SELECT *, total * pow(1 - p, 1.0::DOUBLE) AS adjusted FROM t)
    SELECT customer_id, '1y' AS period, round(total, 2) AS projected_revenue, round(g, 6) AS growth_rate, round(adjusted * 0.75::DOUBLE, 2) AS low, round(adjusted * 1.25::DOUBLE, 2) AS high, round(adjusted, 2) AS risk_adjusted_revenue FROM a""",
)
def revenue_projection(spark, sf_dir):
    monthly = F.col("spent") / F.greatest(F.col("tenure") / 30.0, F.lit(1.0))
    cols = value.projected_revenue(monthly, clamp((F.col("engagement") - 0.5) * 2.0, -1.0, 1.0), F.col("p"), F.lit(360))
    return scored(spark, sf_dir).select("customer_id", *[(c if n == "period" else F.round(c, 6 if n == "growth_rate" else 2)).alias(n) for n, c in cols.items()])


@query(
    "clv_segment",
    f"""WITH {C_SQL} SELECT c_mktsegment AS segment, round(sum(spent), 2) AS total_value, round(avg(spent), 2) AS avg_customer_value, round(sum(spent) / sum(purchases), 2) AS avg_order_value,
    round(avg(CASE WHEN tenure > 0 THEN spent * 365 / tenure ELSE spent END), 2) AS segment_ltv, count(*) AS customer_count FROM c JOIN customer ON c_custkey = customer_id GROUP BY 1""",
)
def clv_segment(spark, sf_dir):
    rows = customers(spark, sf_dir).withColumnRenamed("tenure", "days").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment")), "customer_id")
    out = value.segment_clv(rows, "segment")
    return out.withColumns({c: F.round(c, 2) for c in ("total_value", "avg_customer_value", "avg_order_value", "segment_ltv")})


M_SQL = "m AS (SELECT o_orderpriority AS k, (year(o_orderdate) * 12 + month(o_orderdate))::INT AS t, round(sum(o_totalprice), 2) AS x FROM orders GROUP BY 1, 2)"


def monthly(spark, sf_dir) -> DataFrame:
    """Revenue by order priority and month: k, t, x."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("t")).agg(F.round(F.sum("o_totalprice"), 2).alias("x"))


@query(
    "ses_forecast",
    f"""WITH RECURSIVE {M_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS i, count(*) OVER (PARTITION BY k) AS c FROM m),
    s(k, i, c, level) AS (SELECT k, i, c, x FROM n WHERE i = 1 UNION ALL SELECT n.k, n.i, n.c, 0.3::DOUBLE * n.x + 0.7::DOUBLE * s.level FROM s JOIN n ON n.k = s.k AND n.i = s.i + 1)
    SELECT k, round(level, 2) AS forecast, step::INT AS step FROM s, range(1, 4) r(step) WHERE i = c""",
)
def ses_forecast(spark, sf_dir):
    return value.smoothed(monthly(spark, sf_dir), ["k"], 0.3, 3).withColumn("forecast", F.round("forecast", 2))


@query("moving_average", f"WITH {M_SQL}, w AS (SELECT k, t, avg(x) OVER (PARTITION BY k ORDER BY t ROWS 2 PRECEDING) AS mean, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM m) SELECT k, t, round(mean, 2) AS mean FROM w WHERE i >= 3")
def moving_average(spark, sf_dir):
    return value.moving_average(monthly(spark, sf_dir), ["k"], 3).withColumn("mean", F.round("mean", 2))


@query(
    "trend_halves",
    f"""WITH {M_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY k) AS c FROM m),
    h AS (SELECT k, avg(x) FILTER (i < c // 2) AS a, avg(x) FILTER (i >= c // 2) AS b FROM n GROUP BY 1) SELECT k, round(least(greatest((b - a) / greatest(a, 0.01), -1), 1), 9) AS trend FROM h""",
)
def trend_halves(spark, sf_dir):
    return value.halves_trend(monthly(spark, sf_dir), ["k"]).withColumn("trend", F.round("trend", 9))
