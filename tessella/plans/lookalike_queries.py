"""Queries on lookalike audiences over ``embeddings``, and on privacy over ``customer``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import lookalike, neighbours, privacy
from tessella.plans.registry import query, uniform_sql
from tessella.sources.tables import table

E_SQL = """v AS (SELECT vec_id AS customer_id, label, embedding::DOUBLE[] AS e FROM embeddings),
  cen AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(e[i]) AS m FROM v, range(1, 65) r(i) WHERE label = 0 GROUP BY i))"""
SIM_SQL = {
    "cosine": "list_cosine_similarity(e, c)",
    "euclidean": "1 - least(list_distance(e, c) / 100.0::DOUBLE, 1)",
    "manhattan": "1 - least(list_sum(list_transform(list_zip(e, c), lambda z: abs(z[1] - z[2]))) / 200.0::DOUBLE, 1)",
}


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("customer_id"), "label", F.col("embedding").cast("array<double>").alias("features"), F.col("vec_id").cast("double").alias("ltv"))


def _audience(metric: str):
    sql = f"""WITH {E_SQL}, s AS (SELECT customer_id, round({SIM_SQL[metric]}, 12) AS s FROM v, cen WHERE label <> 0),
      lim AS (SELECT s AS l FROM (SELECT s, row_number() OVER (ORDER BY s DESC) - 1 AS i, count(*) OVER () AS n FROM s) WHERE i = floor(0.1 * n))
      SELECT customer_id, round(s, 6) AS similarity_score FROM s, lim WHERE s > 0 AND s >= l"""

    @query(f"lookalike_{metric}", sql)
    def run(spark, sf_dir):
        v = vectors(spark, sf_dir)
        return lookalike.audience(v.where("label <> 0"), v.where("label = 0"), metric).select("customer_id", F.round("similarity_score", 6).alias("similarity_score"))


for _metric in SIM_SQL:
    _audience(_metric)


@query("similar_top_n", f"WITH {E_SQL}, o AS (SELECT e AS c FROM v WHERE customer_id = 0), s AS (SELECT customer_id, {SIM_SQL['cosine']} AS s, count(*) OVER () AS n FROM v, o WHERE customer_id <> 0) SELECT customer_id, round(s, 6) AS similarity_score, round((row_number() OVER (ORDER BY s DESC, customer_id) - 1) * 100.0::DOUBLE / n, 9) AS percentile FROM s ORDER BY s DESC, customer_id LIMIT 20")
def similar_top_n(spark, sf_dir):
    v = vectors(spark, sf_dir)
    out = lookalike.nearest(v.where("customer_id <> 0"), v.where("customer_id = 0"), 20, "cosine")
    return out.select("customer_id", F.round("similarity_score", 6).alias("similarity_score"), F.round("percentile", 9).alias("percentile"))


KEYS = ["c_nationkey", "c_mktsegment"]


def _k(k: int):
    g = "g AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)"

    @query(f"k_anonymity_check_{k}", f"WITH {g} SELECT coalesce(sum(n) FILTER (n < {k}), 0) = 0 AS is_anonymized, coalesce(sum(n) FILTER (n < {k}), 0)::BIGINT AS suppressed_rows, (sum(n) - coalesce(sum(n) FILTER (n < {k}), 0))::BIGINT AS generalized_rows, round(coalesce(sum(n) FILTER (n < {k}), 0) * 100.0::DOUBLE / sum(n), 9) AS information_loss FROM g")
    def check(spark, sf_dir):
        return privacy.check(table(spark, sf_dir, "customer"), KEYS, k).withColumn("information_loss", F.round("information_loss", 9))

    @query(f"k_anonymity_suppress_{k}", f"WITH {g} SELECT c_custkey, c_nationkey, c_mktsegment FROM customer JOIN g USING (c_nationkey, c_mktsegment) WHERE n >= {k}")
    def suppress(spark, sf_dir):
        return privacy.suppressed(table(spark, sf_dir, "customer").select("c_custkey", *KEYS), KEYS, k)


_k(5)
_k(12)
B_SQL = "b AS (SELECT c_custkey, c_acctbal, least(trunc((c_acctbal - min(c_acctbal) OVER ()) / ((max(c_acctbal) OVER () - min(c_acctbal) OVER ()) / 10))::INT, 9) AS bin, min(c_acctbal) OVER () AS lo, max(c_acctbal) OVER () - min(c_acctbal) OVER () AS span FROM customer)"


@query("generalize_bins", f"WITH {B_SQL} SELECT c_custkey, bin FROM b")
def generalize_bins(spark, sf_dir):
    return privacy.binned(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 10).select("c_custkey", "bin")


@query("information_loss", f"WITH {B_SQL} SELECT round(sqrt(avg(((c_acctbal - (lo + (bin + 0.5::DOUBLE) * span / 10)) / span) ** 2)), 9) AS information_loss FROM b")
def information_loss(spark, sf_dir):
    return privacy.information_loss(table(spark, sf_dir, "customer").select("c_acctbal"), "c_acctbal", 10).withColumn("information_loss", F.round("information_loss", 9))


@query("noise_laplace", f"WITH u AS (SELECT c_custkey, c_acctbal, {uniform_sql('c_custkey', 7)} AS u FROM customer) SELECT c_custkey, round(greatest(c_acctbal + CASE WHEN u < 0.5 THEN 10 * ln(2 * u) ELSE -10 * ln(2 * (1 - u)) END, 0), 6) AS noisy FROM u")
def noise_laplace(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(privacy.laplace(F.col("c_acctbal"), 1.0, 10.0, 7, F.col("c_custkey")), 6).alias("noisy"))


@query("noise_gaussian", f"SELECT c_custkey, round(greatest(c_acctbal + 10 * sqrt(2 * ln(1.25::DOUBLE / 1e-5)) * sqrt(-2 * ln({uniform_sql('c_custkey', 7, 0)})) * cos(2 * pi() * {uniform_sql('c_custkey', 7, 1)}), 0), 6) AS noisy FROM customer")
def noise_gaussian(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(privacy.gaussian(F.col("c_acctbal"), 1.0, 1e-5, 10.0, 7, F.col("c_custkey")), 6).alias("noisy"))


@query(
    "similar_all",
    """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS similarity FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
    SELECT query_id, id, similarity, (row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id))::INT AS place FROM s QUALIFY place <= 10""",
)
def similar_all(spark, sf_dir):
    """The ten nearest of every row whose id is divisible by 100, among all rows."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    return neighbours.top_n(rows.where(F.col("id") % 100 == 0), rows, 10)
