"""Queries on what goes on around segments: rule texts, budgets, stream batches, permissions, messages, small models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import checks
from tessella.operators import accounts, activation, clustering, drift, learning, ledger, lookalike, patterns, privacy, profiling, rfm, segments
from tessella.plans.accounts_queries import R_SQL as RECORDS_SQL
from tessella.plans.accounts_queries import _xy, records
from tessella.plans.clustering_queries import P_SQL, S_SQL, model, points
from tessella.plans.drift_queries import KS_SQL, PS_SQL, long_rows, samples
from tessella.plans.registry import query
from tessella.plans.rfm_queries import base, scores_sql
from tessella.plans.rules_queries import E_SQL, NOW, SEG_SQL, SEGMENTER, events
from tessella.plans.value_queries import C_SQL, customers
from tessella.sources.scratch import fresh, written
from tessella.sources.tables import table
from tessella.streaming import state as stream

# Rules and segments as SQL text, which Spark runs.

RULE_SQL = {
    "big": "spent > 1500000",
    "recent": "recency <= 30 AND purchases >= 5",
    "either": "recency > 365 OR purchases = 1",
    "neither": "NOT (tenure < 2000 OR spent < 100000) AND purchases <> 7",
    "anyone": "true",
}


@query("rules_sql_text", f"WITH {C_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS segment, customer_id FROM c WHERE {w}" for n, w in RULE_SQL.items()))
def rules_sql_text(spark, sf_dir):
    c = customers(spark, sf_dir)
    return reduce(DataFrame.unionAll, [c.where(SEGMENTER.sql(s.name)).select(F.lit(s.name).alias("segment"), "customer_id") for s in SEGMENTER.segments])


@query("rules_sql_export", f"WITH {C_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS segment, count(*) AS customers FROM c WHERE {w}" for n, w in RULE_SQL.items()))
def rules_sql_export(spark, sf_dir):
    """The exported statements themselves, one for each segment."""
    c = customers(spark, sf_dir)
    parts = []
    for statement in SEGMENTER.export("people").split("\n\n"):
        title, _, text = statement.partition("\n")
        found = spark.sql(text.rstrip(";").replace("FROM people", "FROM {people}"), people=c)
        parts.append(found.agg(F.lit(title.removeprefix("-- ")).alias("segment"), F.count("*").alias("customers")))
    return reduce(DataFrame.unionAll, parts)


_SEGMENT_TESTS = " UNION ALL ".join("SELECT '%s' AS segment, count(*) AS customers FROM scored WHERE (recency_score, frequency_score, monetary_score) IN (%s)" % (n, ", ".join(str(tuple(p)) for p in ps)) for n, ps in segments.PATTERNS.items())


@query("sql_export_all_counts", f"WITH {scores_sql('quintile')} {_SEGMENT_TESTS}")
def sql_export_all_counts(spark, sf_dir):
    scored = rfm.scored(base(spark, sf_dir))
    parts = [spark.sql(t.rstrip(";").replace("FROM scored", "FROM {scored}"), scored=scored).agg(F.lit(n).alias("segment"), F.count("*").alias("customers")) for n, t in segments.export_all("postgresql", "scored").items()]
    return reduce(DataFrame.unionAll, parts)


# Privacy budget: each region's count of customers costs 0.3 of 1.0 until it is used up.


@query(
    "privacy_budget",
    """WITH n AS (SELECT n_regionkey AS region, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY region) AS i FROM n)
    SELECT region::BIGINT AS region, i <= 3 AS granted, CASE WHEN i <= 3 THEN n END AS customers, round(least(i, 3) * 30.0::DOUBLE, 6) AS percentage, false AS exhausted FROM o""",
)
def privacy_budget(spark, sf_dir):
    budget = privacy.Budget(1.0)
    steps = []
    for region in range(5):
        granted = budget.consume(privacy.query_cost(0.3, 1.0))
        steps.append((region, granted, budget.percentage, budget.exhausted))
    asked = spark.createDataFrame(steps, "region bigint, granted boolean, percentage double, exhausted boolean")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_regionkey").cast("bigint").alias("region")).agg(F.count("c_custkey").alias("n"))
    return n.join(F.broadcast(asked), "region").select("region", "granted", F.when(F.col("granted"), F.col("n")).alias("customers"), F.round("percentage", 6).alias("percentage"), "exhausted")  # five rows


@query(
    "privacy_ledger",
    """WITH n AS (SELECT n_nationkey::BIGINT AS nation, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY nation) AS i FROM n),
    s AS (SELECT i, least(i * 0.1::DOUBLE, (SELECT min(o.i * least(0.1::DOUBLE, a * 0.005::DOUBLE) + ln(1e6::DOUBLE) / (a - 1)) FROM range(2, 65) t(a))) AS e FROM o), g AS (SELECT max(i) AS last FROM s WHERE e <= 1.5 + 1e-9)
    SELECT nation, i <= last AS granted, CASE WHEN i <= last THEN n END AS customers, round((SELECT e FROM s WHERE s.i = least(o.i, last)), 9) AS spent FROM o, g""",
)
def privacy_ledger(spark, sf_dir):
    """Each nation's count of customers costs 0.1 of 1.5; two askers take turns at one ledger."""
    folder = fresh(spark, "ledger")
    askers = [ledger.Ledger(spark, folder, 1.5) for _ in range(2)]
    steps = []
    for r in table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("nation")).orderBy("nation").collect():  # a dimension table
        granted = askers[r.nation % 2].reserve(ledger.pure(f"customers of {r.nation}", 0.1))
        steps.append((r.nation, granted, askers[1].spent))
    asked = spark.createDataFrame(steps, "nation bigint, granted boolean, spent double")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_nationkey").cast("bigint").alias("nation")).agg(F.count("c_custkey").alias("n"))
    return n.join(F.broadcast(asked), "nation").select("nation", "granted", F.when(F.col("granted"), F.col("n")).alias("customers"), F.round("spent", 9).alias("spent"))  # a row per nation


@query(
    "k_anonymity_cuts",
    """WITH g AS (SELECT c_nationkey, round(c_acctbal) AS b, count(*) AS n FROM customer GROUP BY 1, 2)
    SELECT (SELECT count(*) FROM customer) AS rows, (SELECT sum(c_custkey) FROM customer)::BIGINT AS key_sum, true AS every_group_has_k, (SELECT sum(n) FILTER (n < 10)::DOUBLE / sum(n) FROM g) > 0.5 AS loss_is_less""",
)
def k_anonymity_cuts(spark, sf_dir):
    """Groups of ten customers or more by nation and balance; the loss against that of suppressing what the rounded values leave in small groups."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    cut = written(privacy.median_cuts(rows, ["c_nationkey", "c_acctbal"], 10), "cut")
    lost = rows.groupBy("c_nationkey", F.round("c_acctbal")).agg(F.count("*").alias("n")).agg((F.sum(F.when(F.col("n") < 10, F.col("n"))) / F.sum("n")).alias("suppressed"))
    whole = cut.agg(F.count("*").alias("rows"), F.sum("c_custkey").alias("key_sum"))
    return whole.crossJoin(privacy.cut_loss(cut, ["c_nationkey", "c_acctbal"])).crossJoin(lost).select("rows", "key_sum", (F.col("least_rows") >= 10).alias("every_group_has_k"), (F.col("loss") < F.col("suppressed")).alias("loss_is_less"))  # one row each


# Streams in batches.


@query("stream_batches", f"WITH {E_SQL} SELECT customer_id, frequency, monetary, recency, {SEG_SQL} AS segment FROM r")
def stream_batches(spark, sf_dir):
    """The events as a stream in batches; each batch's changed states are written, the last of each customer is read."""
    kept = fresh(spark, "states")
    # A pattern, as a stream takes no path to a single file.
    given = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    rows = given.select(F.col("user_id").alias("customer_id"), "value", F.col("ts").cast("timestamp").alias("ts"))
    stream.start_states(rows, NOW, lambda states, n: states.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{kept}/batch={n}"), fresh(spark, "stream")).awaitTermination()
    names = ("frequency", "monetary", "recency", "segment")
    last = spark.read.parquet(kept).groupBy("customer_id").agg(F.max_by(F.struct(*names), "batch").alias("s"))
    return last.select("customer_id", F.col("s.frequency").alias("frequency"), F.round("s.monetary", 4).alias("monetary"), F.col("s.recency").alias("recency"), F.col("s.segment").alias("segment"))


@query(
    "stream_smoothing",
    """WITH h AS (SELECT user_id AS customer_id, sum(value) FILTER (event_id % 2 = 0) AS before, sum(value) FILTER (event_id % 2 = 1) AS now FROM events GROUP BY 1)
    SELECT customer_id, round(0.3::DOUBLE * now + (1.0 - 0.3)::DOUBLE * before, 6) AS smoothed, CASE WHEN before <> 0 THEN round((now - before) / before, 6) ELSE 0.0::DOUBLE END AS change FROM h""",
)
def stream_smoothing(spark, sf_dir):
    half = lambda k: F.sum(F.when(F.col("event_id") % 2 == k, F.col("value")))
    h = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("customer_id")).agg(half(0).alias("before"), half(1).alias("now"))
    return h.select("customer_id", F.round(stream.smoothed(F.col("before"), F.col("now"), 0.3), 6).alias("smoothed"), F.round(stream.rate_of_change(F.col("now"), F.col("before")), 6).alias("change"))


_STATE_SQL = f"SELECT user_id, count(*)::DOUBLE AS frequency, sum(value) AS monetary, CAST(trunc((epoch(TIMESTAMP '{NOW}') - max(floor(epoch(ts))::BIGINT)) / 86400) AS BIGINT)::DOUBLE AS recency FROM events"


@query(
    "stream_drift_check",
    f"""WITH s AS (SELECT *, 0 AS side FROM ({_STATE_SQL} WHERE event_id % 2 = 0 GROUP BY 1) UNION ALL SELECT *, 1 FROM ({_STATE_SQL} GROUP BY 1)),
    u AS (SELECT side, 'recency' AS feature, recency AS x FROM s UNION ALL SELECT side, 'frequency', frequency FROM s),
    per AS (SELECT feature, x, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM u GROUP BY 1, 2),
    ks AS (SELECT feature, max(gap) AS drift_score FROM (SELECT feature, abs((sum(a) OVER w)::DOUBLE / (sum(a) OVER v) - (sum(b) OVER w)::DOUBLE / (sum(b) OVER v)) AS gap FROM per WINDOW w AS (PARTITION BY feature ORDER BY x ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY feature)) GROUP BY 1),
    m AS (SELECT avg(monetary) FILTER (side = 0) AS m0, avg(monetary) FILTER (side = 1) AS m1, greatest(var_pop(monetary) FILTER (side = 0), 1e-9) AS v0, greatest(var_pop(monetary) FILTER (side = 1), 1e-9) AS v1 FROM s),
    h AS (SELECT (m0 - m1) * (m0 - m1) / (4 * (v0 + v1)) + 0.5::DOUBLE * ln((v0 + v1) / (2 * sqrt(v0 * v1))) AS d FROM m)
    SELECT feature, round(drift_score, 6) AS drift_score FROM ks UNION ALL SELECT 'monetary', round(least(sqrt(greatest(1 - exp(-d), 0)), 1), 6) FROM h""",
)
def stream_drift_check(spark, sf_dir):
    """Baseline: the states by events of even number; now: those by all."""
    given = events(spark, sf_dir)
    seen = [given.where("seq % 2 = 0"), given]
    watch = stream.Recluster(lambda: stream.state(seen[0], NOW))
    watch.arm()
    seen.pop(0)
    return watch.check().select("feature", F.round("drift_score", 6).alias("drift_score"))


@query("drift_critical", f"WITH {KS_SQL} SELECT coalesce(bool_or(drift_score >= 0.5), false) AS has_critical, count(*) FILTER (drift_score >= 0.1) AS drifted FROM ks")
def drift_critical(spark, sf_dir):
    at = drift.severity_rank(drift.severity(F.col("drift_score")))
    found = drift.kolmogorov_smirnov(samples(spark, sf_dir), ["feature"])
    return found.agg(F.coalesce(F.bool_or(at >= drift.SEVERITIES.index("critical")), F.lit(False)).alias("has_critical"), F.count_if(at > 0).alias("drifted"))


# Categories of lookalikes, affinities, contributions.

_KIND = "CASE WHEN c_acctbal > 0 THEN 'in credit' ELSE 'in debt' END"


@query(
    "lookalike_categories",
    f"""WITH s AS (SELECT c_mktsegment AS m, {_KIND} AS k FROM customer WHERE c_nationkey = 1), um AS (SELECT m FROM s GROUP BY 1 ORDER BY count(*) DESC, m LIMIT 1), uk AS (SELECT k FROM s GROUP BY 1 ORDER BY count(*) DESC, k LIMIT 1)
    SELECT c_custkey AS customer_id, CASE (c_mktsegment = um.m)::INT + ({_KIND} = uk.k)::INT WHEN 2 THEN 1.0::DOUBLE WHEN 1 THEN round(1 / 3.0::DOUBLE, 9) ELSE 0.0::DOUBLE END AS similarity FROM customer, um, uk WHERE c_nationkey <> 1""",
)
def lookalike_categories(spark, sf_dir):
    kind = F.create_map(F.lit("market"), F.col("c_mktsegment"), F.lit("balance"), F.expr(_KIND))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), "c_nationkey", kind.alias("kinds"))
    usual = lookalike.usual_categories(rows.where("c_nationkey = 1"), "kinds").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("usual"))
    return rows.where("c_nationkey <> 1").crossJoin(F.broadcast(usual)).select("customer_id", F.round(lookalike.jaccard(F.col("kinds"), F.col("usual")), 9).alias("similarity"))  # one row


@query("affinity_strength", "SELECT l_linestatus, count(*) FILTER (l_discount * 10 > 0.6::DOUBLE AND greatest(1 + l_quantity / 50, 0.1) > 1.5::DOUBLE) AS strong, count(*) FILTER (l_discount * 10 > 0.7::DOUBLE AND l_quantity / 50 > 0.6::DOUBLE) AS vibrant FROM lineitem GROUP BY 1")
def affinity_strength(spark, sf_dir):
    score, share = F.col("l_discount") * 10, F.col("l_quantity") / 50
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.count_if(patterns.is_strong_affinity(score, share)).alias("strong"), F.count_if(patterns.is_vibrant(score, share)).alias("vibrant"))


@query("shap_values", f"WITH {PS_SQL}, g AS (SELECT feature, avg(x) AS gm FROM long GROUP BY 1) SELECT segment, feature, round((mean - gm) * 0.1::DOUBLE, 4) AS contribution FROM ps JOIN g USING (feature)")
def shap_values(spark, sf_dir):
    rows = long_rows(spark, sf_dir)
    means = rows.groupBy("feature").agg(F.avg("x").alias("base"))
    return rows.groupBy("segment", "feature").agg(F.avg("x").alias("mean")).join(F.broadcast(means), "feature").select("segment", "feature", F.round(profiling.shap_like(F.col("mean"), F.col("base")), 4).alias("contribution"))  # a row per feature


@query(
    "segment_summaries",
    f"""WITH {PS_SQL}, g AS (SELECT feature, avg(x) AS gm FROM long GROUP BY 1), r AS (SELECT segment, feature, round(std / (mx - mn + 1e-10), 6) AS imp, mean, gm FROM ps JOIN g USING (feature)),
    k AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY imp DESC, feature) AS rank FROM r), w AS (SELECT *, imp / greatest(imp, 0.001::DOUBLE) AS share FROM k WHERE rank = 1)
    SELECT segment, 'Segment ' || segment || ' is primarily characterized by ' || CASE WHEN mean > gm THEN 'elevated ' ELSE 'depressed ' END || feature || ' (importance: ' || round_even(share * 100, 0)::BIGINT || '%, ' || floor(share * 100)::BIGINT || ' of members affected).' AS summary FROM w""",
)
def segment_summaries(spark, sf_dir):
    rows = long_rows(spark, sf_dir)
    means = rows.groupBy("feature").agg(F.avg("x").alias("mean"))
    stats = profiling.statistics(rows).select("segment", "feature", F.round("importance", 6).alias("importance"), F.col("mean").alias("value"))
    return profiling.summaries(profiling.explained(stats.join(means, "feature")))


# Clusters: one report, and centres that follow batches.


@query(
    "quality_report",
    f"""WITH {S_SQL}, sil AS (SELECT avg((bi - ai) / greatest(ai, bi)) AS s FROM si), m AS (SELECT cluster, count(*) AS n, avg(x) AS x, avg(y) AS y FROM a GROUP BY 1), sp AS (SELECT m.cluster, m.x, m.y, avg(sqrt((a.x - m.x)**2 + (a.y - m.y)**2)) AS s FROM a JOIN m USING (cluster) GROUP BY 1, 2, 3),
    db AS (SELECT avg(w) AS d FROM (SELECT b.cluster, max((b.s + o.s) / sqrt((b.x - o.x)**2 + (b.y - o.y)**2)) AS w FROM sp b JOIN sp o ON b.cluster <> o.cluster GROUP BY 1)), t AS (SELECT avg(x) AS x, avg(y) AS y, count(*) AS n FROM a),
    bt AS (SELECT sum(m.n * ((m.x - t.x)**2 + (m.y - t.y)**2)) AS b, count(*) AS k FROM m, t), wi AS (SELECT sum((a.x - m.x)**2 + (a.y - m.y)**2) AS w FROM a JOIN m USING (cluster)), ch AS (SELECT (b / (k - 1)) / (w / (n - k)) AS c, k FROM bt, wi, t)
    SELECT round(s, 6) AS silhouette, round(d, 6) AS davies_bouldin, round(c, 4) AS calinski_harabasz, round(i, 4) AS inertia, k AS n_clusters, round(((s + 1) * 50 + (1 - least(d / 10, 1)) * 100 + least(c / 100, 100)) / 3, 5) AS overall_score
    FROM sil, db, ch, (SELECT sum((a.x - c.x)**2 + (a.y - c.y)**2) AS i FROM a JOIN c4 c ON c.k = a.cluster)""",
)
def quality_report(spark, sf_dir):
    fitted = model(spark, sf_dir)
    out = clustering.quality_report(fitted.transform(points(spark, sf_dir)), fitted.centres, exact=True)
    return out.select(*[F.round(c, 6).alias(c) for c in ("silhouette", "davies_bouldin")], *[F.round(c, 4).alias(c) for c in ("calinski_harabasz", "inertia")], "n_clusters", F.round("overall_score", 5).alias("overall_score"))


_NEAR = "arg_min(k, {'d': (p.x - c.x)**2 + (p.y - c.y)**2, 'k': k})"


@query(
    "mini_batches",
    f"""WITH {P_SQL}, c0(k, x, y) AS (VALUES (0, 0.0::DOUBLE, 5.0::DOUBLE), (1, 5.0::DOUBLE, 15.0::DOUBLE)), a1 AS (SELECT id, p.x, p.y, {_NEAR} AS k FROM p, c0 c WHERE id % 2 = 0 GROUP BY id, p.x, p.y),
    c1 AS (SELECT k, coalesce(avg(a1.x), any_value(c0.x)) AS x, coalesce(avg(a1.y), any_value(c0.y)) AS y FROM c0 LEFT JOIN a1 USING (k) GROUP BY k), a2 AS (SELECT id, p.x, p.y, {_NEAR} AS k FROM p, c1 c WHERE id % 2 = 1 GROUP BY id, p.x, p.y),
    c2 AS (SELECT k, coalesce(avg(b.x), any_value(c1.x)) AS x, coalesce(avg(b.y), any_value(c1.y)) AS y FROM c1 LEFT JOIN (SELECT * FROM a1 UNION ALL SELECT * FROM a2) b USING (k) GROUP BY k) SELECT id, {_NEAR}::INT AS cluster FROM p, c2 c GROUP BY id""",
)
def mini_batches(spark, sf_dir):
    """Two batches, the points of even and of odd number, from given centres."""
    p = points(spark, sf_dir)
    batches = clustering.MiniBatch(2)
    batches.centres = [[0.0, 5.0], [5.0, 15.0]]
    batches.partial_fit(p.where("id % 2 = 0")).partial_fit(p.where("id % 2 = 1"))
    return batches.predict(p).select("id", "cluster")


# Small models.


@query(
    "network_layers",
    """WITH n AS (SELECT n_regionkey::BIGINT AS region, count(*) AS k FROM nation GROUP BY 1), l AS (SELECT region, k, unnest([0, 1, 2, 3]) AS place FROM n)
    SELECT region, place::INT AS place, CASE place WHEN 0 THEN 'Input: ' || k WHEN 1 THEN 'Layer 0: ' || k || ' → 4 [tanh]' WHEN 2 THEN 'Layer 1: 4 → 2 [tanh]' ELSE 'Layer 2: 2 → 1 [linear]' END AS layer FROM l""",
)
def network_layers(spark, sf_dir):
    """Of a network for each region, with an input for each of its nations."""
    regions = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("bigint").alias("region")).count().collect()
    rows = [(r.region, i, text) for r in regions for i, text in enumerate(learning.Network(r["count"], 1, (4, 2), "tanh").info())]
    return spark.createDataFrame(rows, "region bigint, place int, layer string")


@query("autoencoder_latent", "WITH x AS (SELECT s_suppkey AS seq, s_acctbal / 10000 AS a, s_nationkey / 25.0::DOUBLE AS b FROM supplier) SELECT seq, round(greatest(0.1::DOUBLE * a + 0.1::DOUBLE * b, 0), 8) AS latent FROM x")
def autoencoder_latent(spark, sf_dir):
    return learning.Autoencoder(2, 1).encode(_xy(spark, sf_dir)).select("seq", F.round(F.col("latent")[0], 8).alias("latent"))


@query("autoencoder_training", "WITH x AS (SELECT s_acctbal / 10000 AS a, s_nationkey / 25.0::DOUBLE AS b FROM supplier), r AS (SELECT *, 0.1::DOUBLE * greatest(0.1::DOUBLE * a + 0.1::DOUBLE * b, 0) AS h FROM x) SELECT round(avg(((a - h)**2 + (b - h)**2) / 2), 8) AS final_loss, count(*) AS samples_trained FROM r")
def autoencoder_training(spark, sf_dir):
    told = learning.Autoencoder(2, 1).train(_xy(spark, sf_dir))
    return spark.createDataFrame([(round(told["final_loss"], 8), told["samples_trained"])], "final_loss double, samples_trained bigint")


@query("activation_slopes", "SELECT s_suppkey AS seq, (s_acctbal > 0)::INT::DOUBLE AS relu, round(1 / (1 + exp(-s_acctbal / 10000)) * (1 - 1 / (1 + exp(-s_acctbal / 10000))), 8) AS sigmoid, round(1 - tanh(s_acctbal / 10000)**2, 8) AS tanh, 1.0::DOUBLE AS linear FROM supplier")
def activation_slopes(spark, sf_dir):
    rows = _xy(spark, sf_dir)
    slope = lambda kind: F.round(learning._applied(learning.SLOPES[kind], "x")[0], 8).alias(kind)
    return rows.select("seq", *[slope(kind) for kind in learning.SLOPES])


# Permissions and messages.


@query("permission_changes", "SELECT c_custkey AS user_id, c_custkey % 2 = 0 AND c_acctbal > 0 AS may_delete, false AS may_view FROM customer")
def permission_changes(spark, sf_dir):
    """Analysts are granted one action and lose another; every other customer is one."""
    rights = accounts.Permissions()
    rights.grant("Analyst", "Delete", "Segment")
    rights.revoke("Analyst", "View", "Segment")
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    users = c.select(k.alias("user_id"), F.when(k % 2 == 0, "Analyst").otherwise("Nobody").alias("role"), (F.col("c_acctbal") > 0).alias("active"))
    asked = c.select(k.alias("user_id"), F.explode(F.array(F.lit("Delete"), F.lit("View"))).alias("action")).withColumn("resource", F.lit("Segment"))
    told = rights.judged(asked, users)
    return told.groupBy("user_id").agg(F.bool_or((F.col("action") == "Delete") & F.col("allowed")).alias("may_delete"), F.bool_or((F.col("action") == "View") & F.col("allowed")).alias("may_view"))


@query("audit_views", "SELECT 'user' AS kind, event_id FROM events WHERE user_id = 3 UNION ALL SELECT 'resource', event_id FROM events WHERE event_type = 'purchase' AND user_id = 5 UNION ALL SELECT 'denied', event_id FROM events WHERE value < 1")
def audit_views(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("resource"), F.col("user_id").cast("string").alias("resource_id"), F.when(F.col("value") < 1, "denied").otherwise("success").alias("status"))
    parts = {"user": accounts.user_events(log, "3"), "resource": accounts.resource_events(log, "purchase", "5"), "denied": accounts.denied(log)}
    return reduce(DataFrame.unionAll, [rows.select(F.lit(kind).alias("kind"), "event_id") for kind, rows in parts.items()])


_PLATFORMS = ("Braze", "Iterable", "Segment", "Custom")
_HOLDS = "CASE platform WHEN 'Braze' THEN email IS NOT NULL OR external_id IS NOT NULL WHEN 'Iterable' THEN email IS NOT NULL WHEN 'Segment' THEN true ELSE %s END" % ("true" if not activation.NEEDS["Custom"] else "false")


@query(
    "activation_changes",
    f"""WITH {RECORDS_SQL}, m AS (SELECT r.*, e.event_type, p.platform FROM r, (VALUES ('SegmentRemoval'), ('PropertyUpdate')) e(event_type), (VALUES ('Braze'), ('Iterable'), ('Segment'), ('Custom')) p(platform))
    SELECT platform, event_type, CASE platform WHEN 'Braze' THEN 'https://rest.iad-01.braze.com/users/track' WHEN 'Iterable' THEN 'https://api.iterable.com/api/users/bulkUpdate' WHEN 'Segment' THEN 'https://api.segment.com/v1/batch' ELSE 'https://example.com/activate' END AS endpoint, count(*) AS messages, count(*) FILTER ({_HOLDS}) AS valid FROM m GROUP BY 1, 2""",
)
def activation_changes(spark, sf_dir):
    """Removals from a segment and updates of properties, by platform."""
    r = records(spark, sf_dir)
    both = activation.messages(r, list(_PLATFORMS), "SegmentRemoval").unionByName(activation.messages(r, list(_PLATFORMS), "PropertyUpdate"))
    return both.groupBy("platform", "event_type", activation.endpoint(F.col("platform")).alias("endpoint")).agg(F.count("*").alias("messages"), F.count_if(activation.valid_for(F.col("platform"))).alias("valid"))


@query("checked_features", f"WITH {P_SQL} SELECT id, [x, y] AS features FROM p")
def checked_features(spark, sf_dir):
    """Vectors that pass the check come out as they were; a number that isn't finite would end the query."""
    return points(spark, sf_dir).select("id", checks.finite(F.col("features")).alias("features"))
