"""Queries on the thirteen segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import rfm, segments
from tessella.plans.registry import query
from tessella.plans.rfm_queries import base, scores_sql

SCORES = ("recency_score", "frequency_score", "monetary_score")


def _in(name: str) -> str:
    return "(recency_score, frequency_score, monetary_score) IN (" + ", ".join(f"({r}, {f}, {m})" for r, f, m in segments.PATTERNS[name]) + ")"


SEGMENT13_SQL = (
    f"CASE WHEN {_in('Champions')} THEN 'Champions' WHEN recency_score = 5 AND (monetary_score = 5 OR frequency_score = 5) THEN 'VIP' "
    + " ".join(f"WHEN {_in(n)} THEN '{n}'" for n in segments.PATTERNS if n not in ("Champions", "VIP", "Need Attention"))
    + " ELSE 'Need Attention' END"
)
#: Scored customers with their segment, as further queries use them.
CUSTOMERS_SQL = f"{scores_sql('quintile')}, customers AS (SELECT *, {SEGMENT13_SQL} AS segment FROM scored)"


def customers(spark, sf_dir) -> DataFrame:
    return rfm.scored(base(spark, sf_dir)).withColumn("segment", segments.segment13(*map(F.col, SCORES)))


@query(
    "segment13_classify",
    f"""WITH {CUSTOMERS_SQL}, mean AS (SELECT *, (recency_score + frequency_score + monetary_score) / 3.0::DOUBLE AS a FROM customers)
    SELECT customer_id, segment, round(1.0::DOUBLE / (1.0::DOUBLE + sqrt(((recency_score - a)*(recency_score - a) + (frequency_score - a)*(frequency_score - a) + (monetary_score - a)*(monetary_score - a)) / 3.0::DOUBLE) / a), 6) AS confidence FROM mean""",
)
def segment13_classify(spark, sf_dir):
    return customers(spark, sf_dir).select("customer_id", "segment", F.round(segments.confidence(*map(F.col, SCORES)), 6).alias("confidence"))


def _dim(values: dict, name: str) -> str:
    return f"CASE segment {' '.join(f'WHEN {k!r} THEN {v!r}' + ('::DOUBLE' if isinstance(v, float) else '') for k, v in values.items())} END AS {name}"


@query("segment13_actions", f"WITH {CUSTOMERS_SQL} SELECT customer_id, segment, {_dim(segments.RISK, 'churn_risk')}, {_dim(segments.ACTION, 'action')} FROM customers")
def segment13_actions(spark, sf_dir):
    return customers(spark, sf_dir).join(segments.dimension(spark), "segment").select("customer_id", "segment", "churn_risk", "action")


NAMES_SQL = "names(segment) AS (VALUES " + ", ".join(f"('{n}')" for n in segments.PATTERNS) + ")"


@query(
    "segment13_profiles",
    f"""WITH {CUSTOMERS_SQL}, {NAMES_SQL}, per AS (SELECT segment, count(*) AS n, avg(monetary) AS m, avg(frequency) AS f, avg(recency) AS r, sum(monetary) AS s FROM customers GROUP BY 1)
    SELECT segment, {_dim(segments.DESCRIPTION, "description")}, coalesce(n, 0)::BIGINT AS size, round(coalesce(m, 0), 4) AS avg_monetary, round(coalesce(f, 0), 6) AS avg_frequency, round(coalesce(r, 0), 6) AS avg_recency,
    CASE WHEN n > 0 THEN {_dim(segments.RISK, "x")[:-5]} ELSE 0.0::DOUBLE END AS churn_risk, round(coalesce(s, 0) / (SELECT sum(monetary) FROM customers), 6) AS revenue_contribution
    FROM names LEFT JOIN per USING (segment)""",
)
def segment13_profiles(spark, sf_dir):
    out = segments.profiles(customers(spark, sf_dir))
    return out.withColumns({"avg_monetary": F.round("avg_monetary", 4), **{c: F.round(c, 6) for c in ("avg_frequency", "avg_recency", "revenue_contribution")}})


def _exported(name: str, *wanted: str, kind: str = "postgresql"):
    """Runs the exported text itself over the scored customers."""
    text = [segments.export_sql(w, kind, "scored").rstrip(";") for w in wanted]
    checked = [segments.export_sql(w, "ansi", "scored").rstrip(";") for w in wanted]

    @query(name, f"WITH {scores_sql('quintile')} " + " UNION ALL ".join(checked))
    def run(spark, sf_dir):
        frame = rfm.scored(base(spark, sf_dir))
        parts = [spark.sql(t.replace("FROM scored", "FROM {scored}"), scored=frame) for t in text]
        return reduce(DataFrame.unionAll, parts)


_exported("sql_export_champions", "Champions")
_exported("sql_export_all_union", *segments.PATTERNS)


_PATTERNS_SQL = "p(segment, i, r, f, m) AS (VALUES " + ", ".join(f"('{n}', {i}, {r}, {f}, {m})" for n, ps in segments.PATTERNS.items() for i, (r, f, m) in enumerate(ps)) + ")"


@query(
    "sql_export_texts",
    f"""WITH {CUSTOMERS_SQL}, {_PATTERNS_SQL}, d(dialect) AS (VALUES {", ".join(f"('{k}')" for k in segments.DIALECTS)}), g AS (SELECT segment, r, f, min(i) AS i, list(m ORDER BY i) AS ms FROM p GROUP BY 1, 2, 3),
    joined AS (SELECT segment, string_agg('(recency_score = ' || r || ' AND frequency_score = ' || f || ' AND monetary_score ' || CASE WHEN len(ms) = 1 THEN '= ' || ms[1] ELSE 'IN (' || array_to_string(ms, ', ') || ')' END || ')', ' OR ' ORDER BY i) AS w FROM g GROUP BY 1),
    one AS (SELECT segment, e, string_agg('(recency_score' || e || r || ' AND frequency_score' || e || f || ' AND monetary_score' || e || m || ')', ' OR ' ORDER BY i) AS w FROM p, (VALUES ('='), (' = ')) s(e) GROUP BY 1, 2)
    SELECT segment, dialect, 'SELECT customer_id' || CASE WHEN dialect = 'bigquery' THEN ' AS customer_id' ELSE '' END || ', ' || chr(39) || segment || chr(39) || ' AS segment' || chr(10) || 'FROM customers' || chr(10) || 'WHERE '
      || CASE WHEN dialect IN ('redshift', 'postgresql', 'sqlserver') THEN joined.w ELSE one.w END || ';' AS sql
    FROM d, joined JOIN one USING (segment) WHERE segment IN (SELECT segment FROM customers) AND one.e = CASE WHEN dialect = 'oracle' THEN '=' ELSE ' = ' END""",
)
def sql_export_texts(spark, sf_dir):
    """The text in every dialect of every segment that customers are in."""
    rows = [(n, d, segments.export_sql(n, d, "customers")) for n in segments.PATTERNS for d in segments.DIALECTS]
    return customers(spark, sf_dir).select("segment").distinct().join(F.broadcast(spark.createDataFrame(rows, "segment string, dialect string, sql string")), "segment")  # a text per segment and dialect
