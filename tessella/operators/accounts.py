"""Business accounts, their hierarchy and governance, and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tessella.functions.columns import bands, clamp, ratio


def company_size(employees: Column) -> Column:
    return bands(employees, [("<=", 10, "micro"), ("<=", 50, "small"), ("<=", 500, "mid_market")], "enterprise")


def arr(monthly: Column) -> Column:
    return monthly * 12.0


def adoption(enabled: Column, total: Column) -> Column:
    return ratio(enabled.cast("double"), total)


def engagement(users: Column, adoption_: Column, calls: Column, tickets: Column) -> Column:
    cap = lambda x, top: F.least(x / top, F.lit(1.0))
    return (cap(users, 100.0) + adoption_ + cap(calls, 1000.0) + (1.0 - cap(tickets, 50.0))) / 4.0


def health(engagement_: Column, trend: Column, churn: Column) -> dict[str, Column]:
    return {"overall_health": F.least(0.4 * engagement_ + 0.35 * (1.0 - churn) + 0.25 * F.greatest(trend, F.lit(0.0)), F.lit(1.0)), "expansion_readiness": engagement_ + F.greatest(trend / 2.0, F.lit(0.0)), "churn_risk": churn, "growth_trajectory": trend}


# What to do about each kind of opportunity.
NEXT_STEPS = {
    "feature_training": ("Schedule training webinar", "Send feature guides"),
    "cross_sell": ("Schedule product review", "Propose add-on modules"),
    "user_seat_upsell": ("Propose team expansion", "Show ROI calculation"),
}


def opportunities(accounts: DataFrame) -> DataFrame:
    """One row per opportunity of (account_id, adoption, trend, users, arr)."""
    steps = lambda kind: F.array(*[F.lit(s) for s in NEXT_STEPS[kind]]).alias("recommended_actions")
    one = lambda holds, kind, mrr, gap: F.when(holds, F.struct(F.lit(kind).alias("opportunity_type"), mrr.alias("estimated_mrr"), gap.alias("adoption_gap"), steps(kind)))
    a, u = F.col("adoption"), F.col("users")
    found = F.array_compact(
        F.array(
            one(a < 0.5, "feature_training", F.col("arr") / 12.0 * 0.2, 1.0 - a),
            one(F.col("trend") > 0.3, "cross_sell", F.col("arr") / 12.0 * 0.15, F.lit(0.2)),
            one((a > 0.8) & (u < 10), "user_seat_upsell", u * 100.0, F.lit(0.0)),
        )
    )
    return accounts.select("account_id", F.explode(found).alias("_")).select("account_id", "_.*")


def segmented(accounts: DataFrame) -> DataFrame:
    """Size and industry segments of (employees, industry, arr, engagement), with their total market."""
    out = accounts.groupBy(F.concat_ws("-", company_size(F.col("employees")), "industry").alias("segment_name")).agg(F.count("*").alias("account_count"), F.avg("arr").alias("avg_arr"), F.avg("engagement").alias("avg_engagement"))
    return out.withColumns({"churn_risk": 1.0 - F.col("avg_engagement"), "expansion_potential": 0.8 * F.col("avg_engagement"), "total_market": F.col("avg_arr") * F.col("account_count")})


def vips(accounts: DataFrame) -> DataFrame:
    return accounts.where((F.col("arr") > 100_000) & ((F.col("engagement") > 0.6) | (F.col("trend") > 0.5)))


def at_risk(accounts: DataFrame) -> DataFrame:
    return accounts.where((F.col("engagement") < 0.4) & (F.col("trend") < -0.3))


def industry_fit(size: Column, growth: Column) -> Column:
    base = F.when(size == "micro", 0.3).when(size == "small", 0.6).when(size == "mid_market", 0.8).otherwise(0.95)
    return F.least(base + F.least(F.greatest(growth, F.lit(-1.0)) / 3.0, F.lit(0.2)), F.lit(1.0))


def hierarchy(companies: DataFrame) -> DataFrame:
    """Children of each of (company_id, parent_id), by one join; depth is 1, or 2 where anything has a parent."""
    kids = companies.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("company_id")).agg(F.array_sort(F.collect_list("company_id")).alias("subsidiaries"))
    return companies.join(kids, "company_id", "left").withColumn("subsidiaries", F.coalesce("subsidiaries", F.array().cast(ArrayType(companies.schema["company_id"].dataType))))


def committee(members: DataFrame) -> DataFrame:
    """Per account of (account_id, title, engagement): size, influence, roles."""
    return members.groupBy("account_id").agg(F.count("*").alias("committee_size"), F.avg(clamp(F.col("engagement"), 0.0, 1.0)).alias("average_influence"), F.array_sort(F.collect_set("title")).alias("decision_roles"))


def decision_power(engagement_: Column) -> Column:
    return bands(engagement_, [(">", 0.8, "high"), (">", 0.5, "medium")], "low")


def intent(signals: DataFrame) -> DataFrame:
    """Per account of (account_id, seq, signal, strength): mean, primary signal (the last of the strongest), labels."""
    s = F.col("overall_intent_score")
    out = signals.groupBy("account_id").agg(F.avg("strength").alias("overall_intent_score"), F.count("*").alias("signals_count"), F.max_by("signal", F.struct("strength", "seq")).alias("primary_intent"))
    return out.withColumns({"intent_trend": bands(s, [(">", 0.7, "accelerating"), (">", 0.4, "active")], "exploring"), "budget_indication": bands(s, [(">", 0.8, "allocated"), (">", 0.5, "budgeted")], "research_phase"), "timeline": bands(s, [(">", 0.75, "0-3 months"), (">", 0.5, "3-6 months")], "6-12 months")})


def account_score(usage: Column, adoption_: Column, expansion: Column, churn: Column) -> dict[str, Column]:
    e, x, c = (usage + adoption_) / 2.0, clamp(expansion * 0.8, 0.0, 1.0), clamp(churn * 0.9, 0.0, 1.0)
    score = (e * 0.4 + x * 0.35 + (1.0 - c) * 0.25) * 100.0
    advice = [(x > 0.6, "Identify expansion opportunities"), (c > 0.5, "Implement retention strategy"), (e < 0.5, "Increase engagement initiatives")]
    return {"health_score": score, "overall_status": bands(score, [(">", 80.0, "thriving"), (">", 60.0, "healthy"), (">", 40.0, "at-risk")], "critical"), "recommendations": F.array_compact(F.array(*[F.when(h, t) for h, t in advice]))}


def lineage_quality(steps: Column) -> Column:
    return clamp(F.pow(F.lit(0.95), steps.cast("double")), 0.1, 1.0)


def stewardship(secondary: Column) -> Column:
    return F.when(secondary > 0, 0.9).otherwise(0.7)


def feasibility(constraints: Column) -> Column:
    """Product over the constraints' texts, each counting for the first kind it names."""
    factor = lambda t: F.when(t.contains("budget"), 0.8).when(t.contains("timeline"), 0.9).when(t.contains("technical"), 0.7).otherwise(1.0)
    return F.aggregate(constraints, F.lit(1.0), lambda p, t: p * factor(t))


def rollout_time(feasibility_: Column) -> Column:
    return bands(feasibility_, [(">", 0.8, "1-2 weeks"), (">", 0.5, "2-4 weeks")], "1-3 months")


def genealogy(versions: DataFrame) -> DataFrame:
    """Per segment of (segment_id, version, parent, reason): current version, ancestors, splits and merges."""
    named = lambda word: F.count_if(F.col("reason").contains(word))
    return versions.groupBy("segment_id").agg(F.max("version").alias("current_version"), F.count("parent").alias("ancestor_count"), named("split").alias("split_events"), named("merge").alias("merge_events"))


def policy_compliance(rules: Column) -> Column:
    return F.when(rules > 0, F.least(1.0 - 1.0 / (rules + 1.0), F.lit(0.95))).otherwise(1.0)


def access_level(grants: Column) -> Column:
    return F.when(grants == 0, "private").when(grants > 5, "shared").otherwise("restricted")


def change_velocity(changes: Column) -> Column:
    return F.least(changes / 30.0, F.lit(1.0))


def change_impact(customers: Column, revenue: Column, contracts: Column) -> dict[str, Column]:
    risk = F.when((customers > 10_000) | (revenue > 1_000_000), "critical").when((customers > 1_000) | (revenue > 100_000), "high").when(customers > 100, "medium").otherwise("low")
    advice = [(contracts > 0, "Review contract terms for affected customers"), (revenue > 50_000, "Notify finance team of revenue impact"), (customers > 5_000, "Plan phased rollout to minimize disruption")]
    return {"risk_level": risk, "recommendations": F.array_compact(F.array(*[F.when(h, t) for h, t in advice])), "approval_required": (customers > 1_000) | (revenue > 100_000)}


# Permissions.

ACTIONS = ("View", "Create", "Edit", "Delete", "Export", "Activate", "Configure", "Admin")
RESOURCES = ("Segment", "Audience", "Dashboard", "Settings", "AuditLog", "Integration")
# What each role may do besides the administrator, who may do all.
GRANTS = {
    "Manager": (("View", "Segment"), ("Create", "Segment"), ("Edit", "Segment"), ("Export", "Audience"), ("Activate", "Audience"), ("View", "Dashboard"), ("View", "AuditLog")),
    "Analyst": (("View", "Segment"), ("View", "Dashboard"), ("Export", "Audience"), ("Create", "Audience")),
    "Viewer": (("View", "Segment"), ("View", "Dashboard"), ("View", "AuditLog")),
}


class Permissions:
    """Role by action by resource; what isn't granted is denied."""

    def __init__(self):
        self.allowed = {("Admin", a, r): True for a in ACTIONS for r in RESOURCES}
        self.allowed |= {(role, a, r): True for role, pairs in GRANTS.items() for a, r in pairs}

    def grant(self, role: str, action: str, resource: str) -> None:
        self.allowed[role, action, resource] = True

    def revoke(self, role: str, action: str, resource: str) -> None:
        self.allowed[role, action, resource] = False

    def check(self, role: str, action: str, resource: str) -> bool:
        return self.allowed.get((role, action, resource), False)

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(*k, v) for k, v in self.allowed.items()], "role string, action string, resource string, allowed boolean")

    def judged(self, requests: DataFrame, users: DataFrame) -> DataFrame:
        """Adds ``allowed`` to (user_id, action, resource) by (user_id, role, active)."""
        known = requests.join(users, "user_id", "left").join(F.broadcast(self.table(requests.sparkSession)), ["role", "action", "resource"], "left")  # a row per permission
        return known.withColumn("allowed", F.coalesce(F.col("allowed") & F.col("active"), F.lit(False)))


def user_events(log: DataFrame, user: str) -> DataFrame:
    return log.where(F.col("user_id") == user)


def resource_events(log: DataFrame, resource: str, resource_id: str) -> DataFrame:
    return log.where((F.col("resource") == resource) & (F.col("resource_id") == resource_id))


def denied(log: DataFrame) -> DataFrame:
    return log.where("status = 'denied'")


# Dashboards.


def trend(now: Column, before: Column) -> Column:
    return F.when(F.abs(now - before) < 0.001, "stable").when(now > before, "up").otherwise("down")


def kpi(now: Column, before: Column) -> dict[str, Column]:
    known = before > 0
    return {"change_percent": F.when(known, (now - before) * 100.0 / F.when(known, before)), "trend": F.when(known, trend(now, before)).otherwise("stable")}


def health_label(score: Column) -> Column:
    return bands(score, [(">=", 0.8, "healthy"), (">=", 0.6, "at_risk")], "declining")


def health_summary(cards: DataFrame) -> DataFrame:
    label = health_label(F.col("health_score"))
    return cards.agg(*[F.count_if(label == k).alias(f"{k}_segments") for k in ("healthy", "at_risk", "declining")], F.count_if(F.col("size_change_percent") > 0).alias("growing_segments"))


def summary(segments: DataFrame) -> DataFrame:
    """Totals over (segment, customers, revenue, ltv, retained)."""
    n = F.sum("customers")
    return segments.agg(n.alias("total_customers"), F.count("*").alias("total_segments"), F.floor(n / F.count("*")).cast("bigint").alias("avg_segment_size"), F.sum("revenue").alias("total_revenue"), (F.sum("ltv") / n).alias("avg_customer_ltv"), (F.sum("retained") / n).alias("overall_retention"), (1.0 - F.sum("retained") / n).alias("overall_churn"))


def export(summary_: DataFrame) -> DataFrame:
    """The summary as texts, one row per figure."""
    two = lambda c: F.format_string("%.2f", F.col(c))
    out = summary_.select(F.col("total_customers").cast("string").alias("total_customers"), F.col("total_segments").cast("string").alias("total_segments"), two("total_revenue").alias("total_revenue"), two("avg_customer_ltv").alias("avg_ltv"), two("overall_retention").alias("retention_rate"), two("overall_churn").alias("churn_rate"))
    return out.unpivot([], out.columns, "name", "value")


def compared(cards: DataFrame, a: str, b: str) -> DataFrame:
    """b less a of two segments, and the one with the better retention."""
    side = lambda k, v: cards.where(F.col("segment") == v).select(*[F.col(c).alias(f"{c}_{k}") for c in ("segment", "customers", "avg_ltv", "retention")])
    both = side("a", a).crossJoin(side("b", b))  # one row each
    better = F.when(F.col("retention_b") > F.col("retention_a"), F.col("segment_b")).otherwise(F.col("segment_a"))
    return both.select("segment_a", "segment_b", (F.col("customers_b") - F.col("customers_a")).alias("size_diff"), (F.col("avg_ltv_b") - F.col("avg_ltv_a")).alias("ltv_diff"), (F.col("retention_b") - F.col("retention_a")).alias("retention_diff"), better.alias("better_segment"))


def audit_numbers(events: DataFrame) -> DataFrame:
    """Adds evt_i ids in order of time, per segment."""
    at = F.row_number().over(Window.partitionBy("segment_id").orderBy("timestamp", "actor")) - 1
    return events.withColumn("event_id", F.concat(F.lit("evt_"), at.cast("string")))


def hierarchy_summary(companies: DataFrame) -> DataFrame:
    """Root (the first of (seq, company_id, parent_id)), nodes, subsidiaries and depth."""
    n = F.count("*")
    return companies.agg(F.min_by("company_id", "seq").alias("root_company"), n.alias("total_nodes"), F.greatest(n - 1, F.lit(0)).alias("subsidiaries_count"), F.when(F.count("parent_id") > 0, 2).otherwise(1).alias("max_depth"))


def segment_contract(min_size: Column, max_churn: Column, min_quality: Column, size: Column, churn: Column, quality: Column) -> Column:
    """Whether a segment keeps its contract of size, churn and quality."""
    return F.when((size >= min_size) & (churn <= max_churn) & (quality >= min_quality), "active").otherwise("breached")


def provenance(sources: Column, transformations: Column) -> Column:
    """Reliability of a feature: a little less where it was transformed."""
    return F.when((transformations > 0) | (sources == 0), 0.9).otherwise(0.98)
