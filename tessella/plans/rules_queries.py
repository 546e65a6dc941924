"""Queries on behavioural rules and on the stream operators, run over tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tessella.operators.rules import Condition, Rule, Segment, Segmenter
from tessella.plans.registry import query
from tessella.plans.value_queries import C_SQL, customers
from tessella.sources.scratch import fresh
from tessella.sources.tables import event_stream, table
from tessella.streaming import drifting, keyed, minibatch
from tessella.streaming import state as stream

SEGMENTER = Segmenter(
    [
        Segment("big", (Rule("spend", (Condition("spent", ">", 1_500_000.0),)),), 2),
        Segment("recent", (Rule("r", (Condition("recency", "<=", 30.0), Condition("purchases", ">=", 5.0))),), 3),
        Segment("either", (Rule("o", (Condition("recency", ">", 365.0), Condition("purchases", "=", 1.0)), "OR"),), 1),
        Segment("neither", (Rule("n", (Condition("tenure", "<", 2000.0), Condition("spent", "<", 100_000.0)), "NOT"), Rule("also", (Condition("purchases", "!=", 7.0),))), 1),
        Segment("anyone", (), 0),
    ]
)
_ALL = ", ".join(f"CASE WHEN {s.sql()} THEN '{s.name}' END" for s in SEGMENTER.segments)
_ORDER = sorted(enumerate(SEGMENTER.segments), key=lambda s: (-s[1].priority, -s[0]))


@query("rules_classify_all", f"WITH {C_SQL} SELECT customer_id, list_filter([{_ALL}], lambda x: x IS NOT NULL) AS segments FROM c")
def rules_classify_all(spark, sf_dir):
    return customers(spark, sf_dir).select("customer_id", SEGMENTER.all_of().alias("segments"))


@query("rules_primary", f"WITH {C_SQL} SELECT customer_id, CASE {' '.join(f'WHEN {s.sql()} THEN {s.name!r}' for _, s in _ORDER)} END AS segment FROM c")
def rules_primary(spark, sf_dir):
    return customers(spark, sf_dir).select("customer_id", SEGMENTER.primary().alias("segment"))


WINDOWED = Segmenter([Segment("busy", (Rule("w", (Condition("o_totalprice", ">", 400_000.0, "SUM", 90), Condition("o_totalprice", ">=", 2.0, "COUNT", 90))),))])


@query(
    "rules_windowed",
    "WITH w AS (SELECT o_custkey, sum(o_totalprice) FILTER (o_orderdate >= TIMESTAMP '2001-08-02' - INTERVAL 90 DAY) AS s, count(*) FILTER (o_orderdate >= TIMESTAMP '2001-08-02' - INTERVAL 90 DAY) AS n FROM orders GROUP BY 1) SELECT o_custkey AS customer_id FROM w WHERE s > 400000 AND n >= 2",
)
def rules_windowed(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    return WINDOWED.prepared(rows, "o_custkey", "2001-08-02").where(WINDOWED.segments[0].column()).select(F.col("o_custkey").alias("customer_id"))


NOW = "2024-02-01 00:00:00"
E_SQL = f"e AS (SELECT user_id AS customer_id, count(*) AS frequency, round(sum(value), 4) AS monetary, CAST(trunc((epoch(TIMESTAMP '{NOW}') - max(floor(epoch(ts))::BIGINT)) / 86400) AS BIGINT) AS recency FROM events GROUP BY 1), r AS (SELECT *, 100 - least(recency, 100)::DOUBLE AS rs, least(frequency, 100)::DOUBLE AS fs, least(monetary / 1000, 100)::DOUBLE AS ms FROM e)"
SEG_SQL = "CASE WHEN (rs + fs + ms) / 3 >= 80 THEN 'Champions' WHEN (rs + fs + ms) / 3 >= 60 THEN 'Loyal Customers' WHEN (rs + fs + ms) / 3 >= 40 THEN 'Potential Loyalists' WHEN (rs + fs + ms) / 3 >= 20 THEN 'At Risk' ELSE 'Lost' END"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("customer_id"), "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


def states(spark, sf_dir):
    return stream.labelled(stream.state(events(spark, sf_dir), NOW))


@query("stream_rfm_state_final", f"WITH {E_SQL} SELECT customer_id, frequency, monetary, recency FROM r")
def stream_rfm_state_final(spark, sf_dir):
    return states(spark, sf_dir).select("customer_id", "frequency", F.round("monetary", 4).alias("monetary"), "recency")


@query("stream_segments_final", f"WITH {E_SQL} SELECT customer_id, {SEG_SQL} AS segment FROM r")
def stream_segments_final(spark, sf_dir):
    return states(spark, sf_dir).select("customer_id", "segment")


@query("stream_distribution", f"WITH {E_SQL} SELECT {SEG_SQL} AS segment, count(*) AS customers FROM r GROUP BY 1")
def stream_distribution(spark, sf_dir):
    return stream.distribution(states(spark, sf_dir))


@query("stream_hourly_stats", "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS window_start, round(sum(value), 4) AS total, count(*) AS count, round(avg(value), 6) AS average, max(value) AS max, min(value) AS min FROM events GROUP BY 1")
def stream_hourly_stats(spark, sf_dir):
    out = stream.window_stats(events(spark, sf_dir), "hour")
    return out.select(F.unix_timestamp("window_start").alias("window_start"), F.round("total", 4).alias("total"), "count", F.round("average", 6).alias("average"), "max", "min")


@query("stream_event_rate", "SELECT DISTINCT user_id AS customer_id, (SELECT 3600 / (greatest(max(floor(epoch(ts))::BIGINT) - min(floor(epoch(ts))::BIGINT), 1) / 1000.0::DOUBLE) FROM events) AS rate FROM events")
def stream_event_rate(spark, sf_dir):
    return stream.event_rate(events(spark, sf_dir), 3600)


@query("stream_event_rate_counted", "SELECT user_id AS customer_id, round(count(*) * 3600 / greatest(max(floor(epoch(ts))::BIGINT) - min(floor(epoch(ts))::BIGINT), 1)::DOUBLE, 9) AS rate FROM events GROUP BY 1")
def stream_event_rate_counted(spark, sf_dir):
    return stream.event_rate(events(spark, sf_dir), 3600, corrected=True).withColumn("rate", F.round("rate", 9))


@query("stream_high_value", f"WITH {E_SQL} SELECT customer_id FROM r WHERE monetary > 3500")
def stream_high_value(spark, sf_dir):
    return stream.high_value(states(spark, sf_dir), 3500.0).select("customer_id")


@query("stream_churn_signals", f"WITH {E_SQL} SELECT customer_id FROM r WHERE recency > 2")
def stream_churn_signals(spark, sf_dir):
    return stream.churn_signals(states(spark, sf_dir), 2).select("customer_id")


@query(
    "stream_sessions",
    """WITH g AS (SELECT user_id, ts, value, coalesce(epoch(ts) - epoch(lag(ts) OVER w) >= 7200, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT user_id AS customer_id, floor(epoch(min(ts)))::BIGINT AS session_start, count(*) AS events, round(sum(value), 4) AS total FROM s GROUP BY user_id, n""",
)
def stream_sessions(spark, sf_dir):
    return stream.sessions(events(spark, sf_dir), "2 hours").select("customer_id", F.unix_timestamp("session_start").alias("session_start"), "events", F.round("total", 4).alias("total"))


@query(
    "stream_updates",
    f"""WITH u AS (SELECT user_id AS customer_id, event_id AS seq, 100 - least(trunc((epoch(TIMESTAMP '{NOW}') - floor(epoch(ts))::BIGINT) / 86400), 100)::DOUBLE AS rs, least(count(*) OVER w, 100)::DOUBLE AS fs, least(sum(value) OVER w / 1000, 100)::DOUBLE AS ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT customer_id, seq, {SEG_SQL} AS new_segment FROM u) SELECT *, lag(new_segment) OVER (PARTITION BY customer_id ORDER BY seq) AS previous_segment, coalesce(lag(new_segment) OVER (PARTITION BY customer_id ORDER BY seq) <> new_segment, true) AS changed, 0.85::DOUBLE AS confidence FROM s""",
)
def stream_updates(spark, sf_dir):
    return stream.updates(events(spark, sf_dir), NOW)


PARTS = 3
_PART_SQL = f"least(event_id * {PARTS} // (SELECT max(event_id) + 1 FROM events), {PARTS - 1})"


def parts(spark, sf_dir):
    """The events with the number of the part, by ranges of seq, in which they arrive."""
    given = events(spark, sf_dir)
    most = given.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_most"))
    return given.crossJoin(F.broadcast(most)).withColumn("part", F.least(F.floor(F.col("seq") * PARTS / (F.col("_most") + 1)), F.lit(PARTS - 1)).cast("int")).drop("_most")  # one row


def arriving(spark, sf_dir, sink, change=keyed.updates):
    """Writes the parts one after another into a folder that a stream reads; the stream ends after each and starts again from its checkpoint."""
    given, folder, checkpoint = parts(spark, sf_dir), fresh(spark, "arriving"), fresh(spark, "stream")
    for k in range(PARTS):
        given.where(F.col("part") == k).drop("part").write.mode("append").parquet(folder)
        rows = event_stream(spark, folder, given.drop("part").schema, 1_000)
        keyed.start(change(rows, NOW), checkpoint, sink).awaitTermination()


@query(
    "stream_keyed_updates",
    f"""WITH u AS (SELECT user_id AS customer_id, event_id AS seq, 100 - least(trunc((epoch(TIMESTAMP '{NOW}') - floor(epoch(ts))::BIGINT) / 86400), 100)::DOUBLE AS rs, least(count(*) OVER w, 100)::DOUBLE AS fs, least(sum(value) OVER w / 1000, 100)::DOUBLE AS ms, count(*) OVER w AS frequency,
      coalesce(floor(epoch(ts)) < max(floor(epoch(ts))) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3600, false) AS late FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT customer_id, seq, frequency, late, {SEG_SQL} AS new_segment FROM u) SELECT *, lag(new_segment) OVER (PARTITION BY customer_id ORDER BY seq) AS previous_segment, coalesce(lag(new_segment) OVER (PARTITION BY customer_id ORDER BY seq) <> new_segment, true) AS changed, 0.85::DOUBLE AS confidence FROM s""",
)
def stream_keyed_updates(spark, sf_dir):
    """Each event's update by keyed state, over runs that start from a checkpoint."""
    out = fresh(spark, "updates")
    arriving(spark, sf_dir, out)
    return spark.read.parquet(out).select("customer_id", "seq", "frequency", "late", "new_segment", "previous_segment", "changed", "confidence")


_PAIRS_SQL = f"""ev AS (SELECT *, {_PART_SQL} AS part FROM events),
    st AS (SELECT j, user_id, count(*)::DOUBLE AS frequency, sum(value) AS monetary, trunc((epoch(TIMESTAMP '{NOW}') - arg_max(floor(epoch(ts))::BIGINT, event_id)) / 86400) AS recency FROM ev, (SELECT unnest(range(0, {PARTS})) AS j) WHERE part <= j GROUP BY 1, 2),
    ij AS (SELECT x.j AS i, y.j AS j FROM (SELECT DISTINCT j FROM st) x, (SELECT DISTINCT j FROM st) y WHERE x.j < y.j),
    u AS (SELECT i, ij.j, 'recency' AS feature, (st.j = ij.j)::INT AS side, recency AS x FROM ij JOIN st ON st.j IN (ij.i, ij.j) UNION ALL SELECT i, ij.j, 'frequency', (st.j = ij.j)::INT, frequency FROM ij JOIN st ON st.j IN (ij.i, ij.j)),
    per AS (SELECT i, j, feature, x, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM u GROUP BY 1, 2, 3, 4),
    ks AS (SELECT i, j, feature, max(gap) AS d FROM (SELECT i, j, feature, abs((sum(a) OVER w)::DOUBLE / (sum(a) OVER v) - (sum(b) OVER w)::DOUBLE / (sum(b) OVER v)) AS gap FROM per WINDOW w AS (PARTITION BY i, j, feature ORDER BY x ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY i, j, feature)) GROUP BY 1, 2, 3),
    m AS (SELECT i, ij.j, avg(monetary) FILTER (st.j = i) AS m0, avg(monetary) FILTER (st.j = ij.j) AS m1, greatest(var_pop(monetary) FILTER (st.j = i), 1e-9) AS v0, greatest(var_pop(monetary) FILTER (st.j = ij.j), 1e-9) AS v1 FROM ij JOIN st ON st.j IN (ij.i, ij.j) GROUP BY 1, 2),
    al AS (SELECT i, j, feature, d FROM ks UNION ALL SELECT i, j, 'monetary', least(sqrt(greatest(1 - exp(-((m0 - m1) * (m0 - m1) / (4 * (v0 + v1)) + 0.5::DOUBLE * ln((v0 + v1) / (2 * sqrt(v0 * v1))))), 0)), 1) FROM m),
    f AS (SELECT i, j, max(d) >= 0.35 AS fired FROM al GROUP BY 1, 2),
    b AS (SELECT 1 AS j, 0 AS i UNION ALL SELECT 2, CASE WHEN (SELECT fired FROM f WHERE i = 0 AND j = 1) THEN 1 ELSE 0 END)"""


@query(
    "stream_recluster",
    f"""WITH {_PAIRS_SQL} SELECT al.j::INT AS batch, feature, round(d, 6) AS drift_score, CASE WHEN d < 0.1 THEN 'none' WHEN d < 0.2 THEN 'low' WHEN d < 0.35 THEN 'medium' WHEN d < 0.5 THEN 'high' ELSE 'critical' END AS severity, fired, al.i::INT AS baseline,
    (SELECT count(*) FROM st WHERE st.j = al.j) AS customers, CASE WHEN fired THEN (SELECT count(*) FROM st WHERE st.j = al.j) ELSE 0 END AS relabelled FROM al JOIN b USING (i, j) JOIN f USING (i, j)""",
)
def stream_recluster(spark, sf_dir):
    """Checks and new clusters of a stream in three batches, with restarts between them; drift comes from sketches."""
    watch = drifting.Watch(spark, fresh(spark, "watch"), NOW)
    arriving(spark, sf_dir, watch)
    log = watch.table("log").where("feature <> ''")
    try:
        labels = watch.table("labels").groupBy("batch").agg(F.count("*").alias("relabelled"))
    except AnalysisException:  # no batch drifted enough
        labels = spark.createDataFrame([], "batch int, relabelled bigint")
    return log.join(F.broadcast(labels), "batch", "left").select("batch", "feature", F.round("drift_score", 6).alias("drift_score"), "severity", "fired", "baseline", "customers", F.coalesce("relabelled", F.lit(0)).alias("relabelled"))  # a row per batch


def _assigned(part: int, centres: str) -> str:
    return f"SELECT v, h, arg_min(k, (v - x) * (v - x) + (h - y) * (h - y)) AS k FROM pt, {centres} WHERE part = {part} GROUP BY event_id, v, h"


_MODEL_SQL = f"pt AS (SELECT event_id, value AS v, (floor(epoch(ts))::BIGINT % 86400) / 3600.0::DOUBLE AS h, {_PART_SQL} AS part FROM events), c0(k, x, y) AS (VALUES (0, 5.0::DOUBLE, 6.0::DOUBLE), (1, 20.0::DOUBLE, 18.0::DOUBLE), (2, 60.0::DOUBLE, 12.0::DOUBLE))"
for _i in range(PARTS):
    _seen = " UNION ALL ".join(f"SELECT * FROM a{j}" for j in range(1, _i + 2))
    _MODEL_SQL += f", a{_i + 1} AS ({_assigned(_i, f'c{_i}')}), c{_i + 1} AS (SELECT c.k, coalesce(avg(v), any_value(c.x)) AS x, coalesce(avg(h), any_value(c.y)) AS y, count(v) AS n FROM c{_i} c LEFT JOIN ({_seen}) b ON b.k = c.k GROUP BY 1)"


@query("stream_mini_batches", f"WITH {_MODEL_SQL} " + " UNION ALL ".join(f"SELECT {i} AS batch, k::INT AS cluster, n, round(x, 6) AS x, round(y, 6) AS y FROM c{i + 1}" for i in range(PARTS)))
def stream_mini_batches(spark, sf_dir):
    """The versions of a model of value and hour that a stream in three batches leaves, the second of which runs twice."""
    sink = minibatch.VersionedMiniBatch(spark, fresh(spark, "model"), 3, [[5.0, 6.0], [20.0, 18.0], [60.0, 12.0]])
    points = lambda rows, _: rows.select(F.array(F.col("value"), F.unix_timestamp("ts") % 86_400 / 3_600.0).alias("features"))

    def twice(batch, number):
        for _ in range(1 + (number == 1)):
            sink(batch, number)

    arriving(spark, sf_dir, twice, points)
    centre = lambda i: F.round(F.col("centre")[i], 6)
    return sink.versions().select("batch", "cluster", "n", centre(0).alias("x"), centre(1).alias("y"))
