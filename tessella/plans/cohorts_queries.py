"""Queries on cohorts by first order, and on lifecycle stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.columns import epoch
from tessella.operators import cohorts
from tessella.plans.registry import query
from tessella.plans.value_queries import C_SQL, customers
from tessella.sources.tables import table


def _ids(period: str):
    days = cohorts.PERIOD_DAYS[period]

    @query(f"cohort_ids_{period}", f"SELECT o_custkey AS customer_id, 'cohort_' || ((epoch(min(o_orderdate))::BIGINT // 86400) // {days}) AS cohort_id FROM orders GROUP BY 1")
    def run(spark, sf_dir):
        first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer_id")).agg(F.min(epoch(F.col("o_orderdate"))).alias("t"))
        return first.select("customer_id", cohorts.cohort_id(F.col("t"), period).alias("cohort_id"))


for _period in cohorts.PERIOD_DAYS:
    _ids(_period)

F_SQL = "f AS (SELECT o_custkey AS customer_id, min(epoch(o_orderdate)::BIGINT // 86400 // 90) AS c, sum(o_totalprice) AS ltv, count(*) > 8 AS retained FROM orders GROUP BY 1)"
CO_SQL = f"{F_SQL}, co AS (SELECT 'cohort_' || c AS cohort_id, count(*) AS size, sum(ltv) AS revenue, avg(ltv) AS avg_ltv, avg(retained::INT::DOUBLE) AS retention_rate_total FROM f GROUP BY 1)"


def firsts(spark, sf_dir):
    t = epoch(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer_id")).agg(F.min(cohorts.cohort_number(t, "quarterly")).alias("c"), F.sum("o_totalprice").alias("ltv"), (F.count("*") > 8).alias("retained"))


def made(spark, sf_dir):
    return cohorts.created(firsts(spark, sf_dir).withColumn("cohort_id", F.concat(F.lit("cohort_"), F.col("c").cast("string"))))


@query("cohort_create", f"WITH {CO_SQL} SELECT cohort_id, size, round(revenue, 2) AS revenue, round(avg_ltv, 2) AS avg_ltv, round(retention_rate_total, 9) AS retention_rate_total, round(1 - retention_rate_total, 9) AS churn_rate_total FROM co")
def cohort_create(spark, sf_dir):
    return made(spark, sf_dir).withColumns({"revenue": F.round("revenue", 2), "avg_ltv": F.round("avg_ltv", 2), "retention_rate_total": F.round("retention_rate_total", 9), "churn_rate_total": F.round("churn_rate_total", 9)})


POINTS_SQL = f"""{CO_SQL}, act AS (SELECT 'cohort_' || c AS cohort_id, (epoch(o_orderdate)::BIGINT // 86400 // 90) - c AS age, count(DISTINCT customer_id) AS retained_count FROM orders JOIN f ON o_custkey = customer_id GROUP BY 1, 2),
pts AS (SELECT cohort_id, age, retained_count, size, retained_count::DOUBLE / size AS retention_rate FROM act JOIN co USING (cohort_id))"""


def points(spark, sf_dir):
    own = firsts(spark, sf_dir).select("customer_id", "c")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer_id"), cohorts.cohort_number(epoch(F.col("o_orderdate")), "quarterly").alias("p")).distinct()
    active = orders.join(own, "customer_id").groupBy(F.concat(F.lit("cohort_"), F.col("c").cast("string")).alias("cohort_id"), (F.col("p") - F.col("c")).alias("age")).agg(F.count("*").alias("retained_count"))
    return cohorts.curve(active, made(spark, sf_dir))


@query("cohort_retention_points", f"WITH {POINTS_SQL} SELECT cohort_id, age, retained_count, size, round(retention_rate, 9) AS retention_rate, round(1 - retention_rate, 9) AS churn_rate FROM pts")
def cohort_retention_points(spark, sf_dir):
    return points(spark, sf_dir).withColumns({c: F.round(c, 9) for c in ("retention_rate", "churn_rate")})


AGES = list(range(0, 28))


@query("cohort_retention_table", f"WITH {POINTS_SQL} SELECT cohort_id, " + ", ".join(f'coalesce(round(max(retention_rate) FILTER (age = {a}), 9), 0) AS "{a}"' for a in AGES) + " FROM pts GROUP BY 1")
def cohort_retention_table(spark, sf_dir):
    out = cohorts.table_of(points(spark, sf_dir), AGES)
    return out.select("cohort_id", *[F.round(F.col(f"`{a}`"), 9).alias(str(a)) for a in AGES])


@query("cohort_decay", f"WITH {POINTS_SQL}, d AS (SELECT cohort_id, arg_min(retention_rate, age) AS a, arg_max(retention_rate, age) AS b, max(age) - min(age) AS s FROM pts GROUP BY 1) SELECT cohort_id, CASE WHEN s > 0 THEN round((b - a) / s, 9) ELSE 0 END AS decay_rate FROM d")
def cohort_decay(spark, sf_dir):
    return cohorts.decay_rate(points(spark, sf_dir)).withColumn("decay_rate", F.round("decay_rate", 9))


@query("cohort_revenue_per_retained", f"WITH {POINTS_SQL}, l AS (SELECT cohort_id, arg_max(retained_count, age) AS n FROM pts GROUP BY 1) SELECT cohort_id, round(revenue / n, 6) AS revenue_per_retained FROM co JOIN l USING (cohort_id)")
def cohort_revenue_per_retained(spark, sf_dir):
    return cohorts.revenue_per_retained(points(spark, sf_dir), made(spark, sf_dir)).withColumn("revenue_per_retained", F.round("revenue_per_retained", 6))


@query("cohort_aggregate", f"WITH {CO_SQL} SELECT cohort_id, sum(size)::BIGINT AS total_size, round(sum(revenue), 2) AS total_revenue, round(avg(retention_rate_total), 9) AS avg_retention, count(*) AS cohort_count FROM co GROUP BY 1")
def cohort_aggregate(spark, sf_dir):
    return cohorts.aggregated(made(spark, sf_dir)).withColumns({"total_revenue": F.round("total_revenue", 2), "avg_retention": F.round("avg_retention", 9)})


@query("cohort_ranking", f"WITH {CO_SQL}, r AS (SELECT cohort_id, round(retention_rate_total, 12) AS q FROM co) SELECT (SELECT cohort_id FROM r ORDER BY q DESC, cohort_id DESC LIMIT 1) AS best, (SELECT cohort_id FROM r ORDER BY q, cohort_id LIMIT 1) AS worst")
def cohort_ranking(spark, sf_dir):
    return cohorts.ranking(made(spark, sf_dir).withColumn("retention_rate_total", F.round("retention_rate_total", 12)))


@query(
    "cohort_compare",
    f"""WITH {CO_SQL}, n AS (SELECT *, lead(cohort_id) OVER (ORDER BY cohort_id) AS nxt FROM co) SELECT a.cohort_id AS cohort_a, b.cohort_id AS cohort_b, b.size - a.size AS size_diff, round(b.revenue - a.revenue, 2) AS revenue_diff,
    round(b.avg_ltv - a.avg_ltv, 2) AS ltv_diff, round(b.retention_rate_total - a.retention_rate_total, 9) AS retention_rate_diff, CASE WHEN b.retention_rate_total > a.retention_rate_total THEN b.cohort_id ELSE a.cohort_id END AS better_performer FROM n a JOIN co b ON a.nxt = b.cohort_id""",
)
def cohort_compare(spark, sf_dir):
    from pyspark.sql import Window

    all_ = made(spark, sf_dir)
    pairs = all_.select(F.col("cohort_id").alias("cohort_a"), F.lead("cohort_id").over(Window.orderBy("cohort_id")).alias("cohort_b")).where("cohort_b IS NOT NULL")
    return cohorts.compared(all_, pairs).withColumns({"revenue_diff": F.round("revenue_diff", 2), "ltv_diff": F.round("ltv_diff", 2), "retention_rate_diff": F.round("retention_rate_diff", 9)})


LIFE_SQL = f"""{C_SQL}, life AS (SELECT *, CASE WHEN tenure < 30 THEN 'onboarding' WHEN recency > 180 THEN 'dormant' WHEN recency > 90 THEN 'at_risk' WHEN tenure > 730 THEN 'mature' ELSE 'active' END AS current_stage,
  (1 - least(recency / 365.0::DOUBLE, 1) + least(purchases / 10.0::DOUBLE, 1)) / 2 AS retention_score FROM c)"""


def lives(spark, sf_dir):
    rows = customers(spark, sf_dir).select("customer_id", F.col("tenure").alias("signup_days"), "purchases", F.col("spent").alias("total_value"), F.col("recency").alias("last_days"), F.col("purchases").cast("double").alias("frequency"))
    return cohorts.lifecycle(rows)


def _case(k: int) -> str:
    return "CASE current_stage " + " ".join(f"WHEN '{s}' THEN {v[k]}::DOUBLE" for s, v in cohorts.STAGES.items()) + " END"


@query("lifecycle_stage", f"WITH {LIFE_SQL} SELECT customer_id, current_stage, {_case(0)} AS stage_confidence, {_case(1)} AS expansion_potential, round(retention_score, 9) AS retention_score, round(spent / purchases, 6) AS avg_order_value FROM life")
def lifecycle_stage(spark, sf_dir):
    return lives(spark, sf_dir).select("customer_id", "current_stage", "stage_confidence", "expansion_potential", F.round("retention_score", 9).alias("retention_score"), F.round("avg_order_value", 6).alias("avg_order_value"))


@query("lifecycle_distribution", f"WITH {LIFE_SQL} SELECT current_stage AS stage, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM life), 6) AS percentage FROM life GROUP BY 1")
def lifecycle_distribution(spark, sf_dir):
    return cohorts.stage_distribution(lives(spark, sf_dir)).withColumn("percentage", F.round("percentage", 6))


@query("vip_at_risk", f"WITH {LIFE_SQL} SELECT customer_id, current_stage, round(spent, 2) AS total_value FROM life WHERE spent > 500000 AND current_stage IN ('at_risk', 'dormant') AND retention_score < 0.5")
def vip_at_risk(spark, sf_dir):
    return cohorts.at_risk_vips(lives(spark, sf_dir), 500_000.0).select("customer_id", "current_stage", F.round("total_value", 2).alias("total_value"))


@query("lifecycle_actions", f"WITH {LIFE_SQL}, t(stage, actions) AS (VALUES " + ", ".join(f"('{k}', {list(v[2])!r})" for k, v in cohorts.STAGES.items()) + ") SELECT stage, any_value(actions) AS actions, count(*) AS customers FROM life JOIN t ON stage = current_stage GROUP BY 1")
def lifecycle_actions(spark, sf_dir):
    """What to do for the stages that customers are in, and for how many."""
    per = lives(spark, sf_dir).groupBy(F.col("current_stage").alias("stage")).agg(F.count("*").alias("customers"))
    return per.join(F.broadcast(cohorts.stage_actions(spark)), "stage").select("stage", "actions", "customers")  # a row per stage


J_SQL = """j AS (SELECT user_id, floor(epoch(ts))::BIGINT AS t, event_id, CASE event_type WHEN 'signup' THEN 'prospect' WHEN 'purchase' THEN 'active' WHEN 'error' THEN 'at_risk' END AS own FROM events),
  s AS (SELECT *, last_value(own IGNORE NULLS) OVER w AS st FROM j WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)),
  m AS (SELECT *, lag(st) OVER w AS fr, (t - lag(t) OVER w) // 86400 AS days FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
  g AS (SELECT fr AS from_stage, st AS to_stage, count(*) AS sample_count, sum(days) AS days FROM m WHERE fr IS NOT NULL AND fr <> st GROUP BY 1, 2),
  tr AS (SELECT from_stage, to_stage, sample_count::DOUBLE / sum(sample_count) OVER (PARTITION BY from_stage) AS probability, (days // sample_count)::BIGINT AS avg_time_in_days, sample_count FROM g)"""


def moves(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "inactivity").otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("customer_id"), epoch(F.col("ts")).alias("ts"), F.col("event_id").alias("seq"), kind.alias("event_type"))
    return cohorts.transitions(rows)


@query("lifecycle_transitions", f"WITH {J_SQL} SELECT from_stage, to_stage, round(probability, 9) AS probability, avg_time_in_days, sample_count FROM tr")
def lifecycle_transitions(spark, sf_dir):
    return moves(spark, sf_dir).withColumn("probability", F.round("probability", 9))


@query("lifecycle_next_stage", f"WITH {J_SQL} SELECT DISTINCT ON (from_stage) from_stage, to_stage AS next_stage, avg_time_in_days AS time_to_next FROM tr ORDER BY from_stage, probability DESC, to_stage")
def lifecycle_next_stage(spark, sf_dir):
    return cohorts.next_stage(moves(spark, sf_dir))
