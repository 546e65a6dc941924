"""Queries on forecasts, replay, scenarios and patterns over ``orders`` and ``events``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import baskets, patterns, temporal
from tessella.plans.registry import query
from tessella.plans.value_queries import M_SQL, monthly
from tessella.sources.tables import table

N_SQL = "n AS (SELECT o_orderpriority AS k, (year(o_orderdate) * 12 + month(o_orderdate))::DOUBLE AS x, count(*)::DOUBLE AS y FROM orders WHERE o_orderdate < DATE '2001-08-01' GROUP BY 1, 2)"


def numbers(spark, sf_dir):
    """Orders by priority and whole month: k, x, y."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("2001-08-01").cast("timestamp_ntz"))
    return o.groupBy(F.col("o_orderpriority").alias("k"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("double").alias("x")).agg(F.count("*").cast("double").alias("y"))


LINE_SQL = f"{N_SQL}, l AS (SELECT k, regr_slope(y, x) AS slope, regr_intercept(y, x) AS b, regr_r2(y, x) AS r2, max(x) AS last_x, count(*) AS n, regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x) AS sse FROM n GROUP BY 1)"


@query(
    "size_forecast",
    f"""WITH {LINE_SQL}, p AS (SELECT *, s::INT AS step, greatest(slope * (last_x + s) + b, 0) AS p FROM l, range(1, 4) r(s)) SELECT k, step, round(p, 4) AS predicted, round(p * 0.9::DOUBLE, 4) AS lower, round(p * 1.1::DOUBLE, 4) AS upper,
    CASE WHEN slope > 0.1 THEN 'growth' WHEN slope < -0.1 THEN 'decline' ELSE 'stable' END AS trend_type, round(r2, 6) AS r_squared FROM p""",
)
def size_forecast(spark, sf_dir):
    return temporal.size_forecast(numbers(spark, sf_dir), ["k"], 3).withColumns({**{c: F.round(c, 4) for c in ("predicted", "lower", "upper")}, "r_squared": F.round("r_squared", 6)})


@query(
    "revenue_forecast",
    f"""WITH {LINE_SQL}, p AS (SELECT *, s::INT AS step, slope * (last_x + s) + b AS p, 1.96::DOUBLE * sqrt(sse / (n - 2)) AS w FROM l, range(1, 4) r(s)) SELECT k, step, round(p, 4) AS predicted, round(p - w, 4) AS lower, round(p + w, 4) AS upper, round(r2, 6) AS accuracy FROM p""",
)
def revenue_forecast(spark, sf_dir):
    return temporal.revenue_forecast(numbers(spark, sf_dir), ["k"], 3).withColumns({**{c: F.round(c, 4) for c in ("predicted", "lower", "upper")}, "accuracy": F.round("accuracy", 6)})


C_SQL = "h AS (SELECT o_orderpriority AS k, year(o_orderdate)::INT AS t, avg((o_totalprice > 250000)::INT::DOUBLE) AS hv, avg((o_orderstatus = 'F')::INT::DOUBLE) AS cr FROM orders WHERE year(o_orderdate) < 2001 GROUP BY 1, 2)"


@query(
    "composition_forecast",
    f"""WITH {C_SQL}, g AS (SELECT k, count(*) AS n, arg_min(hv, t) AS a1, arg_max(hv, t) AS b1, arg_min(cr, t) AS a2, arg_max(cr, t) AS b2, 1 / (1 + var_pop(hv)) AS st FROM h GROUP BY 1)
    SELECT k, s::INT AS step, round(CASE WHEN s = 1 THEN b1 ELSE least(greatest(b1 + (b1 - a1) / (n - 1) * (s - 1), 0), 1) END, 8) AS hv, round(CASE WHEN s = 1 THEN b2 ELSE least(greatest(b2 + (b2 - a2) / (n - 1) * (s - 1), 0), 1) END, 8) AS cr, round(st, 8) AS composition_stability FROM g, range(1, 5) r(s)""",
)
def composition_forecast(spark, sf_dir):
    share = lambda c: F.avg(c.cast("int").cast("double"))
    h = table(spark, sf_dir, "orders").where(F.year("o_orderdate") < 2001).groupBy(F.col("o_orderpriority").alias("k"), F.year("o_orderdate").alias("t")).agg(share(F.col("o_totalprice") > 250_000).alias("hv"), share(F.col("o_orderstatus") == "F").alias("cr"))
    out = temporal.composition_forecast(h, ["k"], ["hv", "cr"], 4)
    flat = out.select("k", "composition_stability", F.posexplode(F.arrays_zip("hv_forecast", "cr_forecast")))
    return flat.select("k", (F.col("pos") + 1).alias("step"), F.round("col.hv_forecast", 8).alias("hv"), F.round("col.cr_forecast", 8).alias("cr"), F.round("composition_stability", 8).alias("composition_stability"))


EV_SQL = "ev AS (SELECT event_type AS segment, event_id AS seq, strftime(ts, '%Y-%m-%d') AS date, CASE WHEN value > 30 THEN 'added' ELSE 'removed' END AS kind, user_id AS member FROM events)"


def membership(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("segment"), F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.when(F.col("value") > 30, "added").otherwise("removed").alias("kind"), F.col("user_id").alias("member"))


@query(
    "history_replay",
    f"""WITH {EV_SQL}, p AS (SELECT *, coalesce(max(CASE WHEN kind = 'removed' THEN seq END) OVER (PARTITION BY segment, member), -1) AS gone FROM ev WHERE date <= '2024-01-20') SELECT segment, member, min(seq) AS since FROM p WHERE kind = 'added' AND seq > gone GROUP BY 1, 2""",
)
def history_replay(spark, sf_dir):
    return temporal.replayed(membership(spark, sf_dir), "2024-01-20")


@query("composition_timeline", f"WITH {EV_SQL} SELECT segment, seq, date, CASE WHEN kind = 'added' THEN member END AS added, CASE WHEN kind = 'removed' THEN member END AS removed, CASE WHEN kind = 'added' THEN 1 ELSE -1 END AS net_change FROM ev WHERE date BETWEEN '2024-01-05' AND '2024-01-06'")
def composition_timeline(spark, sf_dir):
    return temporal.composition_timeline(membership(spark, sf_dir), "2024-01-05", "2024-01-06")


@query(
    "momentum",
    f"""WITH {M_SQL}, g AS (SELECT k, list(x ORDER BY t) AS v FROM m GROUP BY 1), q AS (SELECT k, v, len(v) AS n, v[-1] - v[greatest(len(v) - 5, 0) + 1] AS mo FROM g)
    SELECT k, v[-1] AS current_value, round(mo, 4) AS momentum_score, round(mo - (v[-2] - v[-4]), 4) AS acceleration, CASE WHEN abs(mo) > 5 THEN 'strong' WHEN abs(mo) > 1 THEN 'moderate' ELSE 'weak' END AS trend_strength, round(abs(mo) / (abs(mo) + 5), 9) AS continuation_probability, round(1 - abs(mo) / (abs(mo) + 5), 9) AS reversal_risk FROM q""",
)
def momentum(spark, sf_dir):
    return temporal.momentum(monthly(spark, sf_dir), ["k"], 5).withColumns({**{c: F.round(c, 4) for c in ("momentum_score", "acceleration")}, **{c: F.round(c, 9) for c in ("continuation_probability", "reversal_risk")}})


@query("what_if", "WITH s AS (SELECT c_mktsegment AS segment, count(*) AS size FROM customer GROUP BY 1), p AS (SELECT *, trunc(trunc(size * 1.15::DOUBLE) / 2)::BIGINT AS projected_size FROM s) SELECT segment, size, projected_size, round((sum(projected_size) OVER () - sum(size) OVER ()) * 100.0::DOUBLE / sum(size) OVER (), 9) AS projected_revenue_impact, 0.1::DOUBLE AS projected_churn_impact, 0.7::DOUBLE AS feasibility_score FROM p")
def what_if(spark, sf_dir):
    sizes = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("size"))
    return temporal.what_if(sizes, {"rfm_threshold": 1.5, "n_clusters": 2.0, "churn_threshold": 0.1}).withColumn("projected_revenue_impact", F.round("projected_revenue_impact", 9))


@query("scenario_best", f"WITH {N_SQL}, s AS (SELECT k AS scenario, row_number() OVER (ORDER BY k) AS seq, avg(y) AS r, min(y) AS c FROM n GROUP BY 1) SELECT (SELECT scenario FROM s ORDER BY r DESC, seq DESC LIMIT 1) AS best_revenue_scenario, (SELECT scenario FROM s ORDER BY c, seq LIMIT 1) AS best_churn_mitigation")
def scenario_best(spark, sf_dir):
    from pyspark.sql import Window

    s = numbers(spark, sf_dir).groupBy(F.col("k").alias("scenario")).agg(F.avg("y").alias("revenue_impact"), F.min("y").alias("churn_impact"))
    return temporal.best_scenarios(s.withColumn("seq", F.row_number().over(Window.orderBy("scenario"))))


P_SQL = f"{N_SQL}, p AS (SELECT k, min(y) AS low, max(y) AS high, avg(y) AS mean, count(*)::DOUBLE AS c FROM n GROUP BY 1)"


@query("tornado", f"WITH {P_SQL} SELECT k AS parameter, abs(high - low) AS impact FROM p")
def tornado(spark, sf_dir):
    return temporal.tornado(numbers(spark, sf_dir).groupBy(F.col("k").alias("parameter")).agg(F.min("y").alias("low"), F.max("y").alias("high")))


@query(
    "sensitivity",
    f"WITH {P_SQL} SELECT k, round((high - low) / 10, 6) AS sensitivity_coefficient, round(((high - low) / low) / (10 / 50.0::DOUBLE), 6) AS elasticity, round(abs((high - low) * 100 / low), 6) AS impact_on_segments, round(abs((high - mean) * 100 / mean), 6) AS impact_on_revenue, CASE WHEN abs((high - low) / 10) > 2 THEN 'high' WHEN abs((high - low) / 10) > 1 THEN 'medium' ELSE 'low' END AS risk_level FROM p",
)
def sensitivity(spark, sf_dir):
    p = numbers(spark, sf_dir).groupBy("k").agg(F.min("y").alias("low"), F.max("y").alias("high"), F.avg("y").alias("mean"))
    cols = temporal.sensitivity(F.lit(50.0), F.lit(60.0), F.col("low"), F.col("high"), F.col("mean"), F.col("high"))
    return p.select("k", *[(c if n == "risk_level" else F.round(c, 6)).alias(n) for n, c in cols.items()])


@query("expansion_plan", "WITH s AS (SELECT c_mktsegment AS segment, count(*)::DOUBLE AS n FROM customer GROUP BY 1) SELECT segment, round(abs((n * 1.5::DOUBLE - n) / 4 / n * 100), 6) AS growth_rate_per_quarter, 2000.0::DOUBLE AS engineering_hours, 200000.0::DOUBLE AS marketing_budget, 40000.0::DOUBLE AS infrastructure_cost, round((n * 1.5::DOUBLE - n) / 100 / 242000.0::DOUBLE * 10000, 9) AS roi_projection FROM s")
def expansion_plan(spark, sf_dir):
    s = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").cast("double").alias("n"))
    cols = temporal.expansion(F.col("n"), F.col("n") * 1.5, F.lit(4.0))
    return s.select("segment", *[F.round(c, 9 if n == "roi_projection" else 6).alias(n) for n, c in cols.items()])


@query(
    "churn_forecast",
    f"""WITH {C_SQL}, g AS (SELECT k, arg_min(cr, t) AS a, arg_max(cr, t) AS b, count(*) AS n FROM h GROUP BY 1), r AS (SELECT *, list_transform(range(0, 6), lambda i: CASE WHEN i = 0 THEN b ELSE least(greatest(b + (b - a) / n * i, 0), 1) END) AS rates FROM g),
    q AS (SELECT *, trunc(1000 * list_avg(rates))::BIGINT AS risk FROM r) SELECT k, round(b, 8) AS current_churn_rate, risk AS at_risk_members, trunc(risk * 0.3::DOUBLE)::BIGINT AS intervention_opportunities, risk * 25.0::DOUBLE AS estimated_revenue_at_risk, round(0.65::DOUBLE + least(n * 0.05::DOUBLE, 0.25), 6) AS confidence FROM q""",
)
def churn_forecast(spark, sf_dir):
    h = table(spark, sf_dir, "orders").where(F.year("o_orderdate") < 2001).groupBy(F.col("o_orderpriority").alias("k"), F.year("o_orderdate").alias("t")).agg(F.avg((F.col("o_orderstatus") == "F").cast("int").cast("double")).alias("rate"), F.lit(1000).alias("size"), F.lit(25.0).alias("value"))
    return temporal.churn_forecast(h, ["k"], 6).drop("projected_churn_rates").withColumns({"current_churn_rate": F.round("current_churn_rate", 8), "confidence": F.round("confidence", 6)})


#: The stage that a kind of event stands for.
STAGE_OF = {"signup": "prospect", "view": "onboarding", "click": "growth", "purchase": "mature", "error": "declining"}
_ST = "(VALUES ('prospect', 0), ('onboarding', 1), ('growth', 2), ('mature', 3), ('declining', 4), ('churn', 5)) s(stage, place)"
MK_SQL = (
    "st AS (SELECT user_id, ts, event_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STAGE_OF.items()) + " END AS stage FROM events), nx AS (SELECT stage AS f, lead(stage) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM st),"
    f" mx AS (SELECT f, t, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY f) AS q FROM nx WHERE f IS NOT NULL AND t IS NOT NULL GROUP BY 1, 2), p0 AS (SELECT stage, place, CASE WHEN stage = 'growth' THEN 1.0 ELSE 0.0 END::DOUBLE AS p FROM {_ST})"
)
for _i in range(1, 4):
    MK_SQL += f", p{_i} AS (SELECT s.stage, s.place, coalesce((SELECT sum(a.p * m.q) FROM p{_i - 1} a JOIN mx m ON m.f = a.stage WHERE m.t = s.stage), 0) AS p FROM {_ST})"


@query("lifecycle_forecast", f"WITH {MK_SQL}, e AS (SELECT stage FROM p3 ORDER BY p, place DESC LIMIT 1), a AS (SELECT 1 AS period, stage, p FROM p1 UNION ALL SELECT 2, stage, p FROM p2 UNION ALL SELECT 3, stage, p FROM p3) SELECT period::INT AS period, a.stage, round(p, 9) AS p, e.stage AS expected_next_stage FROM a, e")
def lifecycle_forecast(spark, sf_dir):
    """The chances of one stage after another, as customers' events follow each other."""
    stage = F.element_at(F.create_map(*[F.lit(x) for k in STAGE_OF.items() for x in k]), F.col("event_type"))
    after = F.lead("from_stage").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = table(spark, sf_dir, "events").withColumn("from_stage", stage).withColumn("to_stage", after).where("from_stage IS NOT NULL AND to_stage IS NOT NULL").groupBy("from_stage", "to_stage").agg(F.count("*").alias("n"))
    matrix = pairs.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from_stage")))
    return temporal.stage_forecast(matrix, "growth", 3).withColumn("p", F.round("p", 9))


MV_SQL = "q AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events), tr AS (SELECT event_type AS f, CASE WHEN nx = event_type THEN '*' ELSE nx END AS t, count(*) AS n FROM q WHERE nx IS NOT NULL GROUP BY 1, 2), pr AS (SELECT f, t, n::DOUBLE / sum(n) OVER (PARTITION BY f) AS p FROM tr), cur AS (SELECT user_id AS member, arg_max(event_type, {'a': ts, 'b': event_id}) AS segment FROM events GROUP BY 1)"


@query(
    "member_forecast",
    f"""WITH {MV_SQL}, g AS (SELECT f AS segment, max(p) FILTER (t = '*') AS s, arg_max(t, {{'p': p, 't': t}}) AS nx, max(p) AS m FROM pr GROUP BY 1)
    SELECT member, segment, round(coalesce(s, 0.6), 9) AS probability_stay, round(m, 9) AS probability_move, round(greatest(1 - coalesce(s, 0.6) - m, 0), 9) AS probability_churn, nx AS most_likely_next_segment, round(greatest(greatest(coalesce(s, 0.6), m) - 0.33::DOUBLE, 0), 9) AS forecast_confidence FROM cur JOIN g USING (segment)""",
)
def member_forecast(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    nx = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    moves = e.withColumn("nx", nx).where("nx IS NOT NULL").groupBy(F.col("event_type").alias("from_segment"), F.when(F.col("nx") == F.col("event_type"), "*").otherwise(F.col("nx")).alias("to_segment")).agg(F.count("*").alias("n"))
    moves = moves.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from_segment")))
    members = e.groupBy(F.col("user_id").alias("member")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("segment"))
    out = temporal.member_forecast(members, moves)
    return out.withColumns({c: F.round(c, 9) for c in ("probability_stay", "probability_move", "probability_churn", "forecast_confidence")})


@query(
    "segment_trend",
    f"""WITH {M_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS i, count(*) OVER (PARTITION BY k) AS n FROM m), g AS (SELECT k, regr_slope(x, i) AS s, avg(x) FILTER (i > n - least(greatest(n // 3, 1), 5)) AS ma, stddev_pop(x) / (avg(x) + 0.001::DOUBLE) AS v FROM r GROUP BY 1)
    SELECT k, CASE WHEN s > 0.05 THEN 'increasing' WHEN s < -0.05 THEN 'decreasing' ELSE 'stable' END AS trend_direction, least(abs(s), 1)::DOUBLE AS trend_strength, round(ma, 4) AS moving_average, round(v, 8) AS volatility, round(greatest(1 - least(v, 1), 0.3), 8) AS forecast_accuracy FROM g""",
)
def segment_trend(spark, sf_dir):
    return patterns.trend(monthly(spark, sf_dir), ["k"]).withColumns({"moving_average": F.round("moving_average", 4), "volatility": F.round("volatility", 8), "forecast_accuracy": F.round("forecast_accuracy", 8)})


EM_SQL = f"{N_SQL}, e AS (SELECT k, arg_max(y, x) AS cur, count(*) AS n, (SELECT y FROM n b WHERE b.k = a.k ORDER BY x DESC LIMIT 1 OFFSET 1) AS prev FROM n a GROUP BY 1), g AS (SELECT *, (cur - prev) / prev AS g FROM e)"


@query("emerging_audience", f"WITH {EM_SQL} SELECT k, round((least(greatest(g, 0), 1) + (1 - least(n / 12.0::DOUBLE, 1))) / 2, 9) AS emergence_score, round(g, 9) AS growth_rate, trunc(cur * (1 + g))::BIGINT AS projected_size_next_period, CASE WHEN g > 0.2 THEN 'accelerating' WHEN g > 0.05 THEN 'emerging' ELSE 'plateauing' END AS emergence_status FROM g")
def emerging_audience(spark, sf_dir):
    from pyspark.sql import Window

    at = numbers(spark, sf_dir).withColumn("prev", F.lag("y").over(Window.partitionBy("k").orderBy("x")))
    e = at.groupBy("k").agg(F.max_by("y", "x").alias("cur"), F.max_by("prev", "x").alias("prev"), F.count("*").alias("n"))
    cols = patterns.emerging(F.col("cur"), F.col("prev"), F.col("n"))
    return e.select("k", *[(F.round(c, 9) if n in ("emergence_score", "growth_rate") else c).alias(n) for n, c in cols.items()])


@query(
    "growth_forecast",
    f"""WITH {N_SQL}, g AS (SELECT k, x, y, (y - lag(y) OVER w) / lag(y) OVER w AS g FROM n WINDOW w AS (PARTITION BY k ORDER BY x)), i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY k) AS c FROM g WHERE g IS NOT NULL),
    s AS (SELECT k, avg(g) AS m, avg(g) FILTER (i < c // 2) AS a, avg(g) FILTER (i >= c // 2) AS b, least(stddev_pop(g), 0.3) AS v FROM i GROUP BY 1), z AS (SELECT k, arg_max(y, x) AS cur FROM n GROUP BY 1)
    SELECT k, cur AS current_size, list_transform(range(1, 4), lambda j: trunc(cur * pow(1 + m, j::DOUBLE))::BIGINT) AS forecasted_sizes, CASE WHEN b > a + 0.02 THEN 'accelerating' WHEN b < a - 0.02 THEN 'decelerating' ELSE 'constant' END AS growth_rate_trend, round(greatest(1 - v, 0.5), 8) AS lower, round(least(1 + v, 1.5), 8) AS upper FROM z JOIN s USING (k)""",
)
def growth_forecast(spark, sf_dir):
    out = patterns.growth_forecast(numbers(spark, sf_dir).withColumnsRenamed({"x": "t", "y": "x"}), ["k"], 3)
    return out.withColumns({"lower": F.round("lower", 8), "upper": F.round("upper", 8)})


SG_SQL = "sg AS (SELECT c_mktsegment AS segment, CASE WHEN o_orderpriority = '1-URGENT' THEN 'engagement_increasing' WHEN o_orderpriority = '2-HIGH' THEN 'high_frequency' WHEN o_orderpriority = '3-MEDIUM' THEN 'high_ltv' WHEN o_orderpriority = '5-LOW' THEN 'low_recency' ELSE 'engagement_declining' END AS signal, avg(o_totalprice) / 500000 AS strength FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"


@query(
    "intent_clusters",
    f"""WITH {SG_SQL}, g AS (SELECT segment, sum(CASE WHEN signal IN ('engagement_declining', 'low_recency') THEN strength ELSE 0 END) AS l, sum(CASE WHEN signal IN ('engagement_increasing', 'high_frequency') THEN strength WHEN signal = 'high_ltv' THEN strength / 2 ELSE 0 END) AS g, avg(strength) AS c FROM sg GROUP BY 1)
    SELECT segment, CASE WHEN l > g THEN 'high_churn_risk' WHEN g > l THEN 'growth_opportunity' ELSE 'stable_engagement' END AS intent_type, round(c, 8) AS confidence FROM g""",
)
def intent_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey")
    p = F.col("o_orderpriority")
    signal = F.when(p == "1-URGENT", "engagement_increasing").when(p == "2-HIGH", "high_frequency").when(p == "3-MEDIUM", "high_ltv").when(p == "5-LOW", "low_recency").otherwise("engagement_declining")
    per = rows.groupBy("segment", signal.alias("signal")).agg((F.avg("o_totalprice") / 500_000).alias("strength"))
    return patterns.intents(per, "segment").withColumn("confidence", F.round("confidence", 8))


TR_SQL = "tt AS (SELECT p_brand AS segment, CASE WHEN p_size < 17 THEN 'churn_risk' WHEN p_size < 34 THEN 'growth_rate' ELSE 'premium_value' END AS trait, avg(p_retailprice) / 2000 AS score FROM part GROUP BY 1, 2)"


@query(
    "personas",
    f"""WITH {TR_SQL}, g AS (SELECT segment, sum(CASE WHEN trait = 'churn_risk' THEN score ELSE 0 END) AS c, sum(CASE WHEN trait = 'growth_rate' THEN score ELSE 0 END) AS g, sum(CASE WHEN trait = 'premium_value' THEN score ELSE 0 END) AS v, count(*) AS n, avg(score) AS s FROM tt GROUP BY 1),
    nm AS (SELECT *, CASE WHEN c > g AND c > v THEN 'At-Risk' WHEN g > v THEN 'Growth-Oriented' WHEN v > 0.5 THEN 'High-Value' ELSE 'Engaged' END AS name FROM g)
    SELECT segment, name, name || ' customers with ' || CASE WHEN n > 2 THEN 'diverse' ELSE 'focused' END || ' characteristics. High engagement and targeted approach recommended.' AS description, CASE WHEN s > 0.7 THEN 'high' WHEN s > 0.4 THEN 'medium' ELSE 'low' END AS business_impact FROM nm""",
)
def personas(spark, sf_dir):
    s = F.col("p_size")
    per = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("segment"), F.when(s < 17, "churn_risk").when(s < 34, "growth_rate").otherwise("premium_value").alias("trait")).agg((F.avg("p_retailprice") / 2000).alias("score"))
    return patterns.personas(per, "segment")


@query("hidden_opportunities", "SELECT c_custkey AS segment, round((c_acctbal / 10000) * greatest(1 - c_nationkey / 25.0::DOUBLE, 0), 9) AS opportunity_score, CASE WHEN c_custkey % 300 > 180 THEN 'high' WHEN c_custkey % 300 > 90 THEN 'medium' ELSE 'low' END AS effort_required FROM customer WHERE (c_acctbal / 10000) * greatest(1 - c_nationkey / 25.0::DOUBLE, 0) > 0.2")
def hidden_opportunities(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("segment"), (F.col("c_nationkey") / 25.0).alias("engagement"), (F.col("c_acctbal") / 10_000).alias("ltv"), (F.col("c_custkey") % 300).alias("dormancy_days"))
    return patterns.hidden_opportunities(rows).select("segment", F.round("opportunity_score", 9).alias("opportunity_score"), "effort_required")


PA_SQL = "ow AS (SELECT DISTINCT s_nationkey AS segment, p_brand AS product FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 45), br AS (SELECT DISTINCT p_brand AS b FROM part), co AS (SELECT x.b AS a, y.b AS b, 0.3::DOUBLE AS correlation FROM br x JOIN br y ON x.b < y.b)"


@query(
    "product_affinity",
    f"""WITH {PA_SQL}, h AS (SELECT co.a, co.b, segment, count(DISTINCT product) AS k FROM co JOIN ow ON product IN (co.a, co.b) GROUP BY 1, 2, 3), r AS (SELECT a, b, count(*) FILTER (k = 2)::DOUBLE / count(*) AS co_purchase_rate FROM h GROUP BY 1, 2)
    SELECT a, b, round(coalesce(co_purchase_rate, 0), 9) AS co_purchase_rate, round((0.3::DOUBLE + coalesce(co_purchase_rate, 0)) / 2, 9) AS affinity_score, 1.3::DOUBLE AS lift FROM co LEFT JOIN r USING (a, b)""",
)
def product_affinity(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("a")).distinct()
    pairs = brands.join(F.broadcast(brands.withColumnRenamed("a", "b")), F.col("a") < F.col("b")).withColumn("correlation", F.lit(0.3))  # a few dozen brands
    out = patterns.product_affinities(li.select(F.col("s_nationkey").alias("segment"), F.col("p_brand").alias("product")), pairs)
    return out.select("a", "b", F.round("co_purchase_rate", 9).alias("co_purchase_rate"), F.round("affinity_score", 9).alias("affinity_score"), "lift")


@query(
    "causal_drivers",
    """WITH c AS (SELECT 'l_discount' AS feature, corr(l_discount, l_extendedprice) AS r, 0.2::DOUBLE AS i FROM lineitem UNION ALL SELECT 'l_quantity', corr(l_quantity, l_extendedprice), 0.7::DOUBLE FROM lineitem UNION ALL SELECT 'l_tax', corr(l_tax, l_extendedprice), 0.05::DOUBLE FROM lineitem)
    SELECT feature, CASE WHEN abs(r) > 0.3 AND r > 0 THEN 'positive_driver' WHEN abs(r) > 0.3 THEN 'negative_driver' ELSE 'weak_driver' END AS driver_type, i AS effect_size, CASE WHEN i > 0.1 THEN 0.01 ELSE 0.5 END::DOUBLE AS statistical_significance, CASE WHEN abs(r) > 0.3 AND r > 0 THEN 'positive' WHEN abs(r) > 0.3 THEN 'negative' ELSE 'neutral' END AS direction FROM c""",
)
def causal_drivers(spark, sf_dir):
    weights = {"l_discount": 0.2, "l_quantity": 0.7, "l_tax": 0.05}
    one = table(spark, sf_dir, "lineitem").agg(*[F.corr(c, "l_extendedprice").alias(c) for c in weights])
    rows = one.unpivot([], list(weights), "feature", "correlation").withColumn("importance", F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("feature")))
    return patterns.causal_drivers(rows)


@query("micro_communities", "SELECT c_nationkey::BIGINT AS community_id, count(DISTINCT c_mktsegment) AS member_count, round(count(*) FILTER (c_acctbal > 0)::DOUBLE / count(*), 9) AS cohesion_score, list_transform(list_sort(list(DISTINCT c_mktsegment)), lambda s: s) AS characteristics, count(*) FILTER (c_acctbal > 0)::DOUBLE / count(*) > 0.7 AS vibrant FROM customer GROUP BY 1")
def micro_communities(spark, sf_dir):
    cohesion = (F.count_if(F.col("c_acctbal") > 0) / F.count("*")).alias("cohesion")
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("community_id")).agg(F.array_sort(F.collect_set("c_mktsegment")).alias("characteristics"), cohesion)
    found = patterns.micro_communities(rows.withColumns({"engagement": F.lit(0.7), "growth": F.lit(0.0)}))
    return found.select("community_id", F.col("member_count").cast("bigint").alias("member_count"), F.round("cohesion_score", 9).alias("cohesion_score"), F.transform("shared_characteristics", lambda s: s["name"]).alias("characteristics"), "vibrant")


@query("tribes", "SELECT n_regionkey::BIGINT AS tribe_id, 'region ' || n_regionkey AS tribe_name, count(*) AS member_count, list_sort(list(n_name)) AS core_values, round(count(*) / 25.0::DOUBLE, 9) AS influence_score, 'mainstream' AS market_relevance FROM nation GROUP BY 1, 2")
def tribes(spark, sf_dir):
    key = F.col("n_regionkey").cast("bigint")
    rows = table(spark, sf_dir, "nation").groupBy(key.alias("tribe_id")).agg(F.count("*").alias("size"), F.array_sort(F.collect_list("n_name")).alias("values"))
    return patterns.tribes(rows.withColumns({"tribe_name": F.concat(F.lit("region "), F.col("tribe_id").cast("string")), "influence": F.round(F.col("size") / 25.0, 9)}))


@query("lifecycle_stages", "SELECT o_orderstatus AS stage_name, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders), 6) AS percentage_of_base, round(avg(date_diff('day', o_orderdate::DATE, DATE '2001-08-02')), 6) AS avg_tenure_days, list_sort(list(DISTINCT o_orderpriority)) AS key_behaviors, 0.5::DOUBLE AS transition_rate_to_next FROM orders GROUP BY 1")
def lifecycle_stages(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    days = F.datediff(F.lit("2001-08-02").cast("date"), F.col("o_orderdate").cast("date"))
    rows = orders.groupBy(F.col("o_orderstatus").alias("stage_name")).agg(F.count("*").alias("n"), F.round(F.avg(days), 6).alias("tenure"), F.array_sort(F.collect_set("o_orderpriority")).alias("behaviors"))
    total = rows.agg(F.sum("n").alias("total"))
    rows = rows.crossJoin(F.broadcast(total)).withColumn("percentage", F.round(F.col("n") * 100.0 / F.col("total"), 6))  # one row
    return patterns.lifecycle_stages(rows.withColumn("transition", F.lit(0.5)))


_MOVES = """moves AS (SELECT o_orderpriority AS segment, o_orderkey AS seq, o_orderdate::DATE AS date, CASE WHEN o_orderkey % 3 = 0 THEN 'removed' ELSE 'added' END AS kind, o_custkey AS member FROM orders)"""


@query(
    "history_months",
    f"""WITH {_MOVES}, d AS (SELECT DISTINCT last_day(o_orderdate) AS date FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY segment, member ORDER BY date, seq) AS i FROM moves),
    p AS (SELECT d.date, segment, member, max(i) FILTER (kind = 'removed') AS gone, max(i) AS last FROM d JOIN r ON r.date <= d.date GROUP BY 1, 2, 3),
    m AS (SELECT p.date, p.segment, p.member, arg_min(r.seq, r.i) AS since FROM p JOIN r ON r.segment = p.segment AND r.member = p.member AND r.i > coalesce(p.gone, 0) AND r.i <= p.last AND r.kind = 'added' WHERE p.last > coalesce(p.gone, 0) GROUP BY 1, 2, 3)
    SELECT date::VARCHAR AS date, segment, count(*) AS members, sum(member)::BIGINT AS member_sum, sum(since)::BIGINT AS since_sum FROM m GROUP BY 1, 2""",
)
def history_months(spark, sf_dir):
    """Members of each segment at every month's end."""
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderkey") % 3 == 0, "removed").otherwise("added")
    moves = o.select(F.col("o_orderpriority").alias("segment"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("date").alias("date"), kind.alias("kind"), F.col("o_custkey").alias("member"))
    ends = o.select(F.last_day(F.col("o_orderdate").cast("date")).alias("date")).distinct()
    at = temporal.replayed_at(temporal.validity(moves), ends)
    return at.groupBy(F.col("date").cast("string").alias("date"), "segment").agg(F.count("*").alias("members"), F.sum("member").alias("member_sum"), F.sum("since").alias("since_sum"))


@query(
    "basket_affinity",
    """WITH i AS (SELECT DISTINCT l_orderkey AS basket, l_partkey AS item FROM lineitem), n AS (SELECT item, count(*) AS n FROM i GROUP BY 1),
    p AS (SELECT x.item AS a, y.item AS b, count(*) AS together FROM i x JOIN i y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2)
    SELECT a, b, together, na.n AS n_a, nb.n AS n_b, round(together::DOUBLE / (na.n + nb.n - together), 9) AS similarity FROM p JOIN n na ON na.item = a JOIN n nb ON nb.item = b WHERE together::DOUBLE / (na.n + nb.n - together) >= 0.04""",
)
def basket_affinity(spark, sf_dir):
    """All pairs of parts that share at least a twenty-fifth of their orders."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("item"))
    return baskets.alike(items, 0.04).withColumn("similarity", F.round("similarity", 9))
