"""Queries on clustering over ``supplier`` and customers' scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import clustering
from tessella.plans.registry import query, uniform_sql
from tessella.sources.tables import table

K, ROUNDS = 3, 4
P_SQL = "p AS (SELECT s_suppkey AS id, s_acctbal / 1000 AS x, s_nationkey::DOUBLE AS y FROM supplier)"


def points(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.col("s_acctbal") / 1000, F.col("s_nationkey").cast("double")).alias("features"))


# Unrolled rounds: nearest of the last centres, then means.
C_SQL = f"{P_SQL}, c0 AS (SELECT (i // ((SELECT count(*) FROM p) // {K}))::INT AS k, x, y FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i FROM p) WHERE i % ((SELECT count(*) FROM p) // {K}) = 0 AND i // ((SELECT count(*) FROM p) // {K}) < {K})"
L_SQL = C_SQL
for _r in range(1, ROUNDS + 1):
    L_SQL += f", a{_r} AS (SELECT id, p.x, p.y, arg_min(k, {{'d': (p.x - c.x)**2 + (p.y - c.y)**2, 'k': k}}) AS cluster FROM p, c{_r - 1} c GROUP BY id, p.x, p.y), c{_r} AS (SELECT cluster AS k, avg(x) AS x, avg(y) AS y FROM a{_r} GROUP BY 1)"
A_SQL = f"{L_SQL}, a AS (SELECT id, p.x, p.y, arg_min(k, {{'d': (p.x - c.x)**2 + (p.y - c.y)**2, 'k': k}}) AS cluster FROM p, c{ROUNDS} c GROUP BY id, p.x, p.y)"


def model(spark, sf_dir):
    p = points(spark, sf_dir)
    return clustering.lloyd(p, clustering.strided_centres(p, K), ROUNDS)


def assigned(spark, sf_dir):
    return model(spark, sf_dir).transform(points(spark, sf_dir))


@query("kmeans_strided_exact", f"WITH {L_SQL} SELECT k::INT AS cluster, round(x, 6) AS x, round(y, 6) AS y FROM c{ROUNDS}")
def kmeans_strided_exact(spark, sf_dir):
    rows = [(i, *c) for i, c in enumerate(model(spark, sf_dir).centres)]
    return spark.createDataFrame(rows, "cluster int, x double, y double").select("cluster", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("kmeans_assign", f"WITH {A_SQL} SELECT id, cluster::INT AS cluster FROM a")
def kmeans_assign(spark, sf_dir):
    return assigned(spark, sf_dir).select("id", "cluster")


@query(
    "davies_bouldin",
    f"WITH {A_SQL}, m AS (SELECT cluster, avg(x) AS x, avg(y) AS y FROM a GROUP BY 1), s AS (SELECT m.*, avg(sqrt((a.x - m.x)**2 + (a.y - m.y)**2)) AS s FROM a JOIN m USING (cluster) GROUP BY m.cluster, m.x, m.y), w AS (SELECT b.cluster, max((b.s + o.s) / sqrt((b.x - o.x)**2 + (b.y - o.y)**2)) AS w FROM s b JOIN s o ON b.cluster <> o.cluster GROUP BY 1) SELECT round(avg(w), 8) AS davies_bouldin FROM w",
)
def davies_bouldin(spark, sf_dir):
    return clustering.davies_bouldin(assigned(spark, sf_dir)).select(F.round("davies_bouldin", 8).alias("davies_bouldin"))


@query(
    "calinski_harabasz",
    f"WITH {A_SQL}, m AS (SELECT cluster, count(*) AS n, avg(x) AS x, avg(y) AS y FROM a GROUP BY 1), t AS (SELECT avg(x) AS x, avg(y) AS y, count(*) AS n FROM a), b AS (SELECT sum(m.n * ((m.x - t.x)**2 + (m.y - t.y)**2)) AS b, count(*) AS k FROM m, t), w AS (SELECT sum((a.x - m.x)**2 + (a.y - m.y)**2) AS w FROM a JOIN m USING (cluster)) SELECT round((b / (k - 1)) / (w / (n - k)), 5) AS calinski_harabasz FROM b, w, t",
)
def calinski_harabasz(spark, sf_dir):
    return clustering.calinski_harabasz(assigned(spark, sf_dir)).select(F.round("calinski_harabasz", 5).alias("calinski_harabasz"))


S_SQL = f"{A_SQL}, pr AS (SELECT a.id, a.cluster, o.cluster AS oc, avg(sqrt((a.x - o.x)**2 + (a.y - o.y)**2)) AS d FROM a JOIN a o ON a.id <> o.id GROUP BY 1, 2, 3), si AS (SELECT id, coalesce(max(d) FILTER (oc = cluster), 0) AS ai, min(d) FILTER (oc <> cluster) AS bi FROM pr GROUP BY id)"


@query("silhouette_exact", f"WITH {S_SQL} SELECT round(avg((bi - ai) / greatest(ai, bi)), 8) AS silhouette FROM si")
def silhouette_exact(spark, sf_dir):
    return clustering.silhouette(assigned(spark, sf_dir)).select(F.round("silhouette", 8).alias("silhouette"))


R_SQL = "l AS (SELECT s_nationkey % 4 AS a, (s_suppkey % 4)::INT AS b FROM supplier), n AS (SELECT a, b, count(*) AS n FROM l GROUP BY 1, 2), q AS (SELECT (SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM n) AS p, (SELECT sum(s * (s - 1) / 2.0::DOUBLE) FROM (SELECT sum(n) AS s FROM n GROUP BY a)) AS pa, (SELECT sum(s * (s - 1) / 2.0::DOUBLE) FROM (SELECT sum(n) AS s FROM n GROUP BY b)) AS pb, (SELECT sum(n)::DOUBLE FROM n) AS t, (SELECT sum(n) FROM n WHERE a = b) AS same, (SELECT sum(abs(d)) FROM (SELECT k, sum(d) AS d FROM (SELECT a AS k, n AS d FROM n UNION ALL SELECT b, -n FROM n) GROUP BY 1)) AS gap)"


@query("adjusted_rand", f"WITH {R_SQL} SELECT round((p - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 9) AS adjusted_rand_index, round(same / t, 9) AS correspondence, round(1 - gap / t, 9) AS size_consistency FROM q")
def adjusted_rand(spark, sf_dir):
    labels = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 4).alias("a"), (F.col("s_suppkey") % 4).cast("int").alias("b"))
    return clustering.agreement(labels).select(*[F.round(c, 9).alias(c) for c in ("adjusted_rand_index", "correspondence", "size_consistency")])


@query(
    "dbscan_core_points",
    f"WITH {P_SQL}, n AS (SELECT a.id, count(*) AS n FROM p a JOIN p b ON sqrt((a.x - b.x)**2 + (a.y - b.y)**2) <= 1.5 GROUP BY 1) SELECT id FROM n WHERE n >= 4",
)
def dbscan_core_points(spark, sf_dir):
    return clustering.core_points(points(spark, sf_dir), 1.5, 4)


@query(
    "dbscan_clusters",
    f"""WITH RECURSIVE {P_SQL}, nb AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON sqrt((a.x - b.x)**2 + (a.y - b.y)**2) <= 1.5), core AS (SELECT a AS id FROM nb GROUP BY 1 HAVING count(*) >= 4),
    ce AS (SELECT nb.a, nb.b FROM nb JOIN core c ON c.id = nb.a JOIN core d ON d.id = nb.b), r(id, root) AS (SELECT id, id FROM core UNION SELECT ce.b, r.root FROM r JOIN ce ON ce.a = r.id), m AS (SELECT id, min(root) AS root FROM r GROUP BY 1),
    k AS (SELECT root, row_number() OVER (ORDER BY root) AS cluster FROM (SELECT DISTINCT root FROM m)), cl AS (SELECT m.id, cluster::INT AS cluster FROM m JOIN k USING (root)), bo AS (SELECT nb.a AS id, min(cluster) AS cluster FROM nb JOIN cl ON cl.id = nb.b GROUP BY 1)
    SELECT p.id, coalesce(cl.cluster, bo.cluster) AS cluster FROM p LEFT JOIN cl ON cl.id = p.id LEFT JOIN bo ON bo.id = p.id""",
)
def dbscan_clusters(spark, sf_dir):
    return clustering.dbscan(points(spark, sf_dir), 1.5, 4)


@query("kprototypes_assign", "WITH s AS (SELECT c_custkey AS id, c_acctbal / 1000 AS x, c_nationkey AS g FROM customer), d AS (SELECT id, [x**2 + 2.0::DOUBLE * (g <> 3)::INT, (x - 5)**2 + 2.0::DOUBLE * (g <> 7)::INT, (x - 9)**2 + 2.0::DOUBLE * (g <> 11)::INT] AS d FROM s) SELECT id, list_position(d, list_min(d))::INT - 1 AS cluster FROM d")
def kprototypes_assign(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal") / 1000).alias("features"), F.array("c_nationkey").alias("categories"))
    return clustering.assign_prototypes(rows, [[0.0], [5.0], [9.0]], [[3], [7], [11]], 2.0).select("id", "cluster")


# Seeds: the largest of ln(u)/w, w the squared distance from the seeds there are.
SEED_SQL = f"{P_SQL}, seed0 AS MATERIALIZED (SELECT 0 AS k, x, y FROM p ORDER BY ln({uniform_sql('id', 42, 0)}) DESC LIMIT 1)"
for _i in range(1, 5):
    SEED_SQL += f", seed{_i} AS MATERIALIZED (SELECT {_i} AS k, x, y FROM (SELECT p.id, p.x, p.y, min((p.x - s.x)**2 + (p.y - s.y)**2) AS w FROM p, ({' UNION ALL '.join(f'FROM seed{_j}' for _j in range(_i))}) s GROUP BY 1, 2, 3) WHERE w > 0 ORDER BY ln({uniform_sql('id', 42, _i)}) / w DESC LIMIT 1)"

# Rounds carry all centres as a list and end where it stays as it is.
FIT_SQL = f"""{SEED_SQL}, r(step, cs, was) AS (SELECT 0, list({{'k': k, 'x': x, 'y': y}} ORDER BY k), NULL::STRUCT(k INT, x DOUBLE, y DOUBLE)[] FROM ({' UNION ALL '.join(f'FROM seed{_j}' for _j in range(5))})
    UNION ALL SELECT step + 1, list({{'k': k, 'x': x, 'y': y}} ORDER BY k), any_value(cs) FROM (SELECT step, cs, k, avg(x) AS x, avg(y) AS y FROM (
      SELECT step, cs, p.id, p.x, p.y, arg_min(c.k, {{'d': (p.x - c.x)**2 + (p.y - c.y)**2, 'k': c.k}}) AS k FROM (SELECT *, unnest(cs) AS c FROM r WHERE step < 300 AND cs IS DISTINCT FROM was), p GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3) GROUP BY step)"""


@query("kmeans_fit", f"WITH RECURSIVE {FIT_SQL} SELECT id, arg_min(c.k, {{'d': (p.x - c.x)**2 + (p.y - c.y)**2, 'k': c.k}})::INT AS cluster FROM p, (SELECT unnest(cs) AS c FROM (FROM r ORDER BY step DESC LIMIT 1)) GROUP BY id")
def kmeans_fit(spark, sf_dir):
    p = points(spark, sf_dir)
    return clustering.fit_kmeans(p, 5).transform(p).select("id", "cluster")


_MIXED_SQL = "arg_min(c.k, {'d': (p.x - c.x)**2 + (p.y - c.y)**2 + (SELECT g FROM gamma) * (p.y::INT <> c.g)::INT, 'k': c.k})"
# A mode is the most frequent category, the largest of equals; the first is that of the nearest point.
MIXED_SQL = f"""{SEED_SQL}, gamma AS MATERIALIZED (SELECT greatest(sqrt((var_pop(x) + var_pop(y)) / 2), 1e-9) AS g FROM p), near AS (SELECT p.id, p.y::INT AS g, arg_min(s.k, {{'d': (p.x - s.x)**2 + (p.y - s.y)**2, 'k': s.k}}) AS k, min((p.x - s.x)**2 + (p.y - s.y)**2) AS d FROM p, (FROM seed0 UNION ALL FROM seed1 UNION ALL FROM seed2) s GROUP BY 1, 2),
    first AS (SELECT s.k, s.x, s.y, arg_min(n.g, n.d) AS g FROM (FROM seed0 UNION ALL FROM seed1 UNION ALL FROM seed2) s JOIN near n USING (k) GROUP BY 1, 2, 3),
    r(step, cs, was) AS (SELECT 0, list({{'k': k, 'x': x, 'y': y, 'g': g}} ORDER BY k), NULL::STRUCT(k INT, x DOUBLE, y DOUBLE, g INT)[] FROM first
    UNION ALL SELECT step + 1, list({{'k': k, 'x': x, 'y': y, 'g': g}} ORDER BY k), any_value(cs) FROM (SELECT step, cs, k, sum(sx) / sum(n) AS x, sum(sy) / sum(n) AS y, arg_max(g, {{'n': n, 'g': g}}) AS g FROM (SELECT step, cs, k, g, count(*) AS n, sum(x) AS sx, sum(y) AS sy FROM (
      SELECT step, cs, p.id, p.x, p.y, p.y::INT AS g, {_MIXED_SQL} AS k FROM (SELECT *, unnest(cs) AS c FROM r WHERE step < 10 AND cs IS DISTINCT FROM was), p GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) GROUP BY step)"""


@query("kprototypes_fit", f"WITH RECURSIVE {MIXED_SQL} SELECT id, {_MIXED_SQL}::INT AS cluster FROM p, (SELECT unnest(cs) AS c FROM (FROM r ORDER BY step DESC LIMIT 1)) GROUP BY id")
def kprototypes_fit(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("categories", F.array(F.col("features")[1].cast("int")))
    centres, modes, gamma = clustering.fit_prototypes(p, 3, max_iter=10)
    return clustering.assign_prototypes(p, centres, modes, gamma).select("id", "cluster")


# One fit for each k, each ending by its inertia, which is taken about the new centres.
K_SQL = f"{P_SQL}, i AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM p)"
for _k in range(2, 5):
    K_SQL += f""", r{_k}(step, cs, inertia, last) AS (SELECT 0, list({{'k': i // (n // {_k}), 'x': x, 'y': y}} ORDER BY i), 'inf'::DOUBLE, NULL::DOUBLE FROM i WHERE i % (n // {_k}) = 0 AND i // (n // {_k}) < {_k}
    UNION ALL SELECT step + 1, list_sort(list(DISTINCT {{'k': k, 'x': mx, 'y': my}})), sum((x - mx)**2 + (y - my)**2), any_value(inertia) FROM (SELECT *, avg(x) OVER (PARTITION BY step, k) AS mx, avg(y) OVER (PARTITION BY step, k) AS my FROM (
      SELECT step, inertia, p.id, p.x, p.y, arg_min(c.k, {{'d': (p.x - c.x)**2 + (p.y - c.y)**2, 'k': c.k}}) AS k FROM (SELECT *, unnest(cs) AS c FROM r{_k} WHERE step < 100 AND (step < 2 OR abs(last - inertia) >= 1e-6)), p GROUP BY 1, 2, 3, 4, 5)) GROUP BY step),
    m{_k} AS MATERIALIZED (FROM r{_k} ORDER BY step DESC LIMIT 1), a{_k} AS MATERIALIZED (SELECT id, p.x, p.y, arg_min(c.k, {{'d': (p.x - c.x)**2 + (p.y - c.y)**2, 'k': c.k}}) AS k, min(sqrt((p.x - c.x)**2 + (p.y - c.y)**2)) AS d FROM p, (SELECT unnest(cs) AS c FROM m{_k}) GROUP BY 1, 2, 3),
    q{_k} AS (SELECT a.id, a.k, b.k AS o, sum((a.x - b.x)**2 + (a.y - b.y)**2) / (count(*) - (a.k = b.k)::INT) AS d, count(*) AS n FROM a{_k} a, a{_k} b GROUP BY 1, 2, 3),
    v{_k} AS (SELECT id, max(d) FILTER (k = o) AS ai, max(n) FILTER (k = o) AS n, min(d) FILTER (k <> o) AS bi FROM q{_k} GROUP BY id),
    e{_k} AS (SELECT {_k} AS k, (SELECT inertia FROM m{_k}) AS inertia, (SELECT log2(((max(x) - min(x))**2 + (max(y) - min(y))**2) / 12 * count(*)) FROM p) - (SELECT log2(avg(d)) FROM a{_k}) AS gap, (SELECT avg(CASE WHEN n = 1 THEN 0 ELSE (bi - ai) / greatest(ai, bi) END) FROM v{_k}) AS sil)"""
K_SQL += """, e AS (FROM e2 UNION ALL FROM e3 UNION ALL FROM e4), f AS (SELECT 'elbow' AS method, CASE WHEN abs(max(inertia) FILTER (k = 2) - 2 * max(inertia) FILTER (k = 3) + max(inertia) FILTER (k = 4)) > 0 THEN 3 ELSE 2 END AS k, 1 / (1 + 3**0.25) AS confidence FROM e
    UNION ALL SELECT 'gap_statistic', arg_max(k, {'s': gap, 'k': k}), least(greatest(max(gap) / 10, 0), 1) FROM e UNION ALL SELECT 'silhouette', arg_max(k, {'s': sil, 'k': k}), max(sil) FROM e),
    w AS (SELECT k, count(*) AS n FROM f GROUP BY k)"""


@query("k_estimates", f"WITH RECURSIVE {K_SQL} SELECT method, k::INT AS k, round(confidence, 8) AS confidence FROM (FROM f UNION ALL SELECT 'combined', min(k), any_value(n) / 3::DOUBLE FROM w WHERE n = (SELECT max(n) FROM w))")
def k_estimates(spark, sf_dir):
    return clustering.estimate_k(points(spark, sf_dir), 2, 4).withColumn("confidence", F.round("confidence", 8))


_WIDE_SQL = "p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), nb AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON list_distance(a.v, b.v) <= EPS)"
WIDE_EPS, WIDE_LEAST = 1.2, 6


@query(
    "dbscan_wide",
    f"""WITH RECURSIVE {_WIDE_SQL.replace("EPS", str(WIDE_EPS))}, core AS MATERIALIZED (SELECT a AS id FROM nb GROUP BY 1 HAVING count(*) >= {WIDE_LEAST}),
    ce AS MATERIALIZED (SELECT nb.a, nb.b FROM nb JOIN core c ON c.id = nb.a JOIN core d ON d.id = nb.b), r(id, root) AS (SELECT id, id FROM core UNION SELECT ce.b, r.root FROM r JOIN ce ON ce.a = r.id), m AS MATERIALIZED (SELECT id, min(root) AS root FROM r GROUP BY 1),
    k AS (SELECT root, row_number() OVER (ORDER BY root) AS cluster FROM (SELECT DISTINCT root FROM m)), cl AS MATERIALIZED (SELECT m.id, cluster::INT AS cluster FROM m JOIN k USING (root)), bo AS (SELECT nb.a AS id, min(cluster) AS cluster FROM nb JOIN cl ON cl.id = nb.b GROUP BY 1)
    SELECT p.id, coalesce(cl.cluster, bo.cluster) AS cluster FROM p LEFT JOIN cl ON cl.id = p.id LEFT JOIN bo ON bo.id = p.id""",
)
def dbscan_wide(spark, sf_dir):
    """Density clusters of the embeddings, whose many axes cells meet on by a tree of boxes."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    return clustering.dbscan(rows, WIDE_EPS, WIDE_LEAST)


# Unrolled rounds: memberships in the last centres, then weighted means.
SOFT_ROUNDS = 10
SOFT_SQL = C_SQL
for _r in range(1, SOFT_ROUNDS + 2):
    SOFT_SQL += f", e{_r} AS (SELECT p.*, c.k, c.x AS cx, c.y AS cy, exp(-((p.x - c.x)**2 + (p.y - c.y)**2)) AS e FROM p, c{_r - 1} c), m{_r} AS (SELECT *, CASE WHEN sum(e) OVER (PARTITION BY id) > 0 THEN e / sum(e) OVER (PARTITION BY id) ELSE 1 / {K}::DOUBLE END AS m FROM e{_r})"
    SOFT_SQL += f", c{_r} AS (SELECT k, CASE WHEN sum(m) > 1e-10 THEN sum(m * x) / sum(m) ELSE any_value(cx) END AS x, CASE WHEN sum(m) > 1e-10 THEN sum(m * y) / sum(m) ELSE any_value(cy) END AS y FROM m{_r} GROUP BY k)"


@query("soft_clusters", f"WITH {SOFT_SQL} SELECT id, arg_max(k, {{'m': m, 'k': k}})::INT AS cluster FROM m{SOFT_ROUNDS + 1} GROUP BY id")
def soft_clusters(spark, sf_dir):
    return clustering.soft_clusters(points(spark, sf_dir), K, SOFT_ROUNDS)[0].select("id", "cluster")


# Unrolled merges; there are 25 brands at most, so 21 lead to four clusters. A merged cluster is the last.
MERGED_SQL = "b AS (SELECT p_brand AS id, avg(p_retailprice) AS x, avg(p_size) * 20 AS y FROM part GROUP BY 1), g0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) AS o, x, y, 1::DOUBLE AS w, [id] AS ids FROM b)"
for _r in range(1, 22):
    MERGED_SQL += f", t{_r} AS MATERIALIZED (SELECT unnest([p.o, q.o]) AS o FROM (SELECT a.o AS i, b.o AS j FROM g{_r - 1} a JOIN g{_r - 1} b ON a.o < b.o WHERE (SELECT count(*) FROM g{_r - 1}) > 4 ORDER BY sqrt((a.x - b.x)**2 + (a.y - b.y)**2), a.o, b.o LIMIT 1) n JOIN g{_r - 1} p ON p.o = n.i JOIN g{_r - 1} q ON q.o = n.j)"
    MERGED_SQL += f", g{_r} AS MATERIALIZED (SELECT * FROM g{_r - 1} WHERE o NOT IN (SELECT o FROM t{_r}) UNION ALL SELECT (SELECT max(o) + 1 FROM g{_r - 1}), sum(x * w) / sum(w), sum(y * w) / sum(w), sum(w), flatten(list(ids)) FROM g{_r - 1} WHERE o IN (SELECT o FROM t{_r}) HAVING count(*) > 0)"


@query("agglomerated", f"WITH {MERGED_SQL} SELECT 'brands' AS of, unnest(ids) AS id, (row_number() OVER (ORDER BY o) - 1)::INT AS cluster FROM g21")
def agglomerated(spark, sf_dir):
    """Brands by mean price and size."""
    b = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id")).agg(F.array(F.avg("p_retailprice"), F.avg("p_size") * 20).alias("features"))
    return clustering.agglomerated(b.withColumn("of", F.lit("brands")), ["of"], 4)
