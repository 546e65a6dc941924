"""Thirteen customer segments from score triples, and their export as SQL text.

One table of patterns feeds the classifier, the segment dimension and the
exported queries.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Segment names, patterns (recency, frequency, monetary), churn
# risks, descriptions and actions.
PATTERNS: dict[str, tuple[tuple[int, int, int], ...]] = {
    "Champions": ((5, 5, 5), (5, 5, 4), (5, 4, 5), (4, 5, 5)),
    "VIP": ((5, 3, 5), (5, 2, 5), (5, 1, 5)),
    "Loyal Customers": ((4, 4, 4), (4, 4, 5), (4, 5, 4)),
    "Potential Loyalists": ((5, 3, 4), (4, 3, 5)),
    "Cannot Lose Them": ((3, 4, 5), (3, 5, 5), (2, 4, 5), (2, 5, 5)),
    "At Risk": ((2, 2, 4), (2, 2, 5), (2, 3, 4), (2, 3, 5), (3, 2, 4), (3, 2, 5)),
    "About to Sleep": ((2, 2, 3), (2, 2, 2), (2, 3, 2), (2, 3, 3)),
    "New Customers": ((5, 4, 3), (5, 4, 2), (5, 3, 3), (5, 3, 2)),
    "Promising": ((5, 2, 3), (5, 2, 4)),
    "Need Attention": ((4, 2, 2), (4, 3, 2), (4, 3, 3)),
    "Lost": ((1, 1, 1), (1, 1, 2), (1, 2, 1)),
    "At Risk - Sleeping": ((1, 3, 4), (1, 3, 5), (1, 4, 4), (1, 4, 5)),
    "Hibernating": ((1, 2, 3), (1, 2, 4), (1, 2, 5), (1, 3, 2), (1, 3, 3)),
}
FALLBACK = "Need Attention"
RISK = {
    "Champions": 0.02,
    "VIP": 0.01,
    "Loyal Customers": 0.05,
    "Potential Loyalists": 0.15,
    "Cannot Lose Them": 0.85,
    "At Risk": 0.9,
    "About to Sleep": 0.8,
    "New Customers": 0.3,
    "Promising": 0.2,
    "Need Attention": 0.5,
    "Lost": 0.95,
    "At Risk - Sleeping": 0.75,
    "Hibernating": 0.7,
}
DESCRIPTION = {
    "Champions": "Best customers with highest value and engagement",
    "VIP": "Premium customers with exceptional value metrics",
    "Loyal Customers": "Consistent, valuable customers with steady engagement",
    "Potential Loyalists": "Recent high-value customers with growth potential",
    "Cannot Lose Them": "High-value customers at risk of churn - critical retention",
    "At Risk": "Once valuable customers showing declining engagement",
    "About to Sleep": "Low engagement customers at risk of dormancy",
    "New Customers": "Recently acquired customers with high potential",
    "Promising": "New customers showing early signs of high value",
    "Need Attention": "Moderate-value customers requiring engagement",
    "Lost": "Inactive customers unlikely to return",
    "At Risk - Sleeping": "Previously inactive customers showing re-engagement",
    "Hibernating": "Inactive but potentially recoverable customers",
}
ACTION = {
    "Champions": "Reward loyalty, ask for referrals",
    "VIP": "Exclusive experiences, personalization",
    "Loyal Customers": "Maintain engagement, upsell opportunities",
    "Potential Loyalists": "Personalized engagement, nurture relationship",
    "Cannot Lose Them": "Priority retention, VIP treatment",
    "At Risk": "Win-back campaign, special offers",
    "About to Sleep": "Targeted win-back, special incentives",
    "New Customers": "Welcome series, onboarding support",
    "Promising": "Regular engagement, growth nurturing",
    "Need Attention": "Re-engagement campaign, surveys",
    "Lost": "Sunset, or aggressive win-back",
    "At Risk - Sleeping": "Reactivation campaign, incentives",
    "Hibernating": "Careful reactivation, special offer",
}
DIALECTS = ("ansi", "snowflake", "bigquery", "redshift", "postgresql", "oracle", "sqlserver", "mysql")
ALIASES = {"postgres": "postgresql", "mssql": "sqlserver", "sql_server": "sqlserver"}


def segment13(r: Column, f: Column, m: Column) -> Column:
    """The segment of a score triple. VIP also takes what is left of 5,*,5 and 5,5,*."""
    triple = r * 100 + f * 10 + m
    out = F.when(triple.isin([100 * a + 10 * b + c for a, b, c in PATTERNS["Champions"]]), "Champions")
    out = out.when((r == 5) & ((m == 5) | (f == 5)), "VIP")
    for name, patterns in PATTERNS.items():
        if name not in ("Champions", "VIP", FALLBACK):
            out = out.when(triple.isin([100 * a + 10 * b + c for a, b, c in patterns]), name)
    return out.otherwise(FALLBACK)


def confidence(r: Column, f: Column, m: Column) -> Column:
    """1 / (1 + coefficient of variation of the three scores)."""
    s = [x.cast("double") for x in (r, f, m)]
    mean = (s[0] + s[1] + s[2]) / 3.0
    deviation = F.sqrt(sum(((x - mean) * (x - mean) for x in s[1:]), (s[0] - mean) * (s[0] - mean)) / 3.0)
    return F.when(mean > 0, 1.0 / (1.0 + deviation / mean)).otherwise(1.0)


def dimension(spark: SparkSession) -> DataFrame:
    """One row per segment: segment, description, churn_risk, action."""
    return spark.createDataFrame([(n, DESCRIPTION[n], RISK[n], ACTION[n]) for n in PATTERNS], "segment string, description string, churn_risk double, action string")


def profiles(customers: DataFrame) -> DataFrame:
    """Per segment, all thirteen: size, averages, churn risk and share of revenue.

    ``customers`` has segment, recency, frequency, monetary. One aggregation;
    the total of revenue is the sum of the thirteen parts.
    """
    per = customers.groupBy("segment").agg(
        F.count("*").alias("size"), F.avg("monetary").alias("avg_monetary"), F.avg("frequency").alias("avg_frequency"), F.avg("recency").alias("avg_recency"), F.sum("monetary").alias("_revenue")
    )
    rows = dimension(customers.sparkSession).join(per, "segment", "left")
    total = F.sum("_revenue").over(_all())
    filled = {c: F.coalesce(c, F.lit(0.0)) for c in ("avg_monetary", "avg_frequency", "avg_recency")}
    return rows.select(
        "segment",
        "description",
        F.coalesce("size", F.lit(0)).alias("size"),
        *[x.alias(c) for c, x in filled.items()],
        F.when(F.col("size") > 0, F.col("churn_risk")).otherwise(0.0).alias("churn_risk"),
        F.when((total > 0) & F.col("_revenue").isNotNull(), F.col("_revenue") / total).otherwise(0.0).alias("revenue_contribution"),
    )


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()


def dialect(name: str) -> str:
    found = ALIASES.get(name.lower(), name.lower())
    if found not in DIALECTS:
        raise ValueError(f"unknown SQL dialect {name}; there are {', '.join(DIALECTS)}")
    return found


_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*")


def identifier(name: str) -> str:
    """The name, if it is dotted words and nothing else."""
    if not _IDENTIFIER.fullmatch(name):
        raise ValueError(f"{name!r} is no identifier")
    return name


def patterns_of(segment: str) -> list[tuple[int, int, int]]:
    if segment not in PATTERNS:
        raise ValueError(f"unknown segment {segment!r}; there are {', '.join(PATTERNS)}")
    return list(PATTERNS[segment])


def export_sql(segment: str, sql_dialect: str, table: str, customer_id: str = "customer_id", recency_score: str = "recency_score", frequency_score: str = "frequency_score", monetary_score: str = "monetary_score") -> str:
    """A query for the customers of one segment in one of the dialects.

    The patterns of redshift, postgresql and sqlserver are grouped with IN;
    oracle has no spaces around its equals signs.
    """
    kind, patterns = dialect(sql_dialect), patterns_of(segment)
    for name in (table, customer_id, recency_score, frequency_score, monetary_score):
        identifier(name)
    names = (recency_score, frequency_score, monetary_score)
    equals = "=" if kind == "oracle" else " = "
    if kind in ("redshift", "postgresql", "sqlserver"):
        groups: dict[tuple[int, int], list[int]] = {}
        for r, f, m in patterns:
            groups.setdefault((r, f), []).append(m)
        tests = [[f"{names[0]} = {r}", f"{names[1]} = {f}", f"{names[2]} = {ms[0]}" if len(ms) == 1 else f"{names[2]} IN ({', '.join(map(str, ms))})"] for (r, f), ms in groups.items()]
    else:
        tests = [[f"{n}{equals}{v}" for n, v in zip(names, p, strict=True)] for p in patterns]
    where = " OR ".join(f"({' AND '.join(t)})" for t in tests)
    shown = f"{customer_id} AS customer_id" if kind == "bigquery" else customer_id
    return f"SELECT {shown}, '{segment}' AS segment\nFROM {table}\nWHERE {where};"


def export_all(sql_dialect: str, table: str, **columns: str) -> dict[str, str]:
    return {name: export_sql(name, sql_dialect, table, **columns) for name in PATTERNS}
