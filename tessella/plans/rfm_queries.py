"""Queries on recency, frequency and monetary value over ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import rfm
from tessella.plans.registry import query
from tessella.sources.tables import transactions

#: The day after the last order of the test tables.
AS_OF = "2001-08-02 00:00:00"

BASE_SQL = f"""base AS (
  SELECT o_custkey AS customer_id,
         CAST(trunc((epoch(TIMESTAMP '{AS_OF}') - epoch(max(o_orderdate))) / 86400) AS DOUBLE) AS recency,
         CAST(count(*) AS DOUBLE) AS frequency, sum(o_totalprice) AS monetary
  FROM orders GROUP BY o_custkey)"""


def base(spark, sf_dir):
    return rfm.base(transactions(spark, sf_dir), AS_OF)


@query("rfm_base", f"WITH {BASE_SQL} SELECT customer_id, recency, frequency, round(monetary, 2) AS monetary FROM base")
def rfm_base(spark, sf_dir):
    return base(spark, sf_dir).withColumn("monetary", F.round("monetary", 2))


def scores_sql(method: str) -> str:
    top = rfm.SCORE_TOP[method]
    if method == "percentile":
        raw = "CAST(trunc((1.0::DOUBLE - i{d}::DOUBLE / n) * 100.0::DOUBLE) AS INTEGER)"
    else:
        raw = f"CAST(ceil({top} * (i{{d}}::DOUBLE / n)) AS INTEGER)"
    cols = ", ".join(f"least(greatest({raw.format(d=d)}, 1), {top}) AS {name}" for d, name in (("r", "recency_score"), ("f", "frequency_score"), ("m", "monetary_score")))
    return f"""{BASE_SQL}, pos AS (
  SELECT *, count(*) OVER () AS n,
    row_number() OVER (ORDER BY recency DESC, customer_id) - 1 AS ir,
    row_number() OVER (ORDER BY frequency DESC, recency DESC, customer_id) - 1 AS if,
    row_number() OVER (ORDER BY monetary DESC, frequency DESC, recency DESC, customer_id) - 1 AS im
  FROM base), scored AS (SELECT customer_id, recency, frequency, monetary, {cols} FROM pos)"""


def _scores(method):
    @query(f"rfm_scores_{method}", f"WITH {scores_sql(method)} SELECT customer_id, recency_score, frequency_score, monetary_score FROM scored")
    def run(spark, sf_dir):
        return rfm.scored(base(spark, sf_dir), method).select("customer_id", "recency_score", "frequency_score", "monetary_score")


for _method in rfm.SCORE_TOP:
    _scores(_method)

SEGMENT8_SQL = """CASE WHEN recency_score >= 4 AND frequency_score >= 4 AND monetary_score >= 4 THEN 'Champions'
  WHEN recency_score >= 4 AND frequency_score >= 4 THEN 'Loyal Customers'
  WHEN recency_score >= 4 AND monetary_score >= 4 THEN 'Potential Loyalists'
  WHEN recency_score >= 4 THEN 'At Risk'
  WHEN frequency_score >= 4 AND monetary_score >= 4 THEN 'VIP'
  WHEN frequency_score >= 4 THEN 'Need Attention'
  WHEN monetary_score >= 4 THEN 'Promising' ELSE 'Lost' END"""


@query(
    "rfm_segment8",
    f"""WITH {scores_sql("quintile")} SELECT customer_id, recency, frequency, round(monetary, 2) AS monetary,
    recency_score, frequency_score, monetary_score, {SEGMENT8_SQL} AS rfm_segment,
    recency_score || '' || frequency_score || '' || monetary_score AS rfm_rank FROM scored""",
)
def rfm_segment8(spark, sf_dir):
    s = [F.col(c) for c in ("recency_score", "frequency_score", "monetary_score")]
    return (
        rfm.scored(base(spark, sf_dir))
        .withColumn("monetary", F.round("monetary", 2))
        .withColumn("rfm_segment", rfm.segment8(*s))
        .withColumn("rfm_rank", rfm.rank_text(*s))
    )


DECAY_SQL = {
    "linear": "least(greatest((90.0::DOUBLE - recency) / 90.0::DOUBLE, 0), 1)",
    "exponential": "least(pow(2.0::DOUBLE, -recency / 30), 1)",
    "inverse": "1.0::DOUBLE / (1.0::DOUBLE + recency / 30)",
}


def _decay(kind):
    @query(f"rfm_decay_{kind}", f"WITH {BASE_SQL} SELECT customer_id, round({DECAY_SQL[kind]}, 9) AS weight FROM base")
    def run(spark, sf_dir):
        return base(spark, sf_dir).select("customer_id", F.round(rfm.decay(F.col("recency"), kind), 9).alias("weight"))


for _kind in DECAY_SQL:
    _decay(_kind)


@query(
    "rfm_normalized",
    f"""WITH {BASE_SQL} SELECT customer_id,
    round((recency - min(recency) OVER ()) / (max(recency) OVER () - min(recency) OVER ()), 6) AS recency,
    round((frequency - min(frequency) OVER ()) / (max(frequency) OVER () - min(frequency) OVER ()), 6) AS frequency,
    round((monetary - min(monetary) OVER ()) / (max(monetary) OVER () - min(monetary) OVER ()), 6) AS monetary FROM base""",
)
def rfm_normalized(spark, sf_dir):
    out = rfm.normalized(base(spark, sf_dir))
    return out.select("customer_id", *[F.round(c, 6).alias(c) for c in ("recency", "frequency", "monetary")])
