import datetime

from pyspark.sql import functions as F

from tessella.sources.tables import event_stream
from tessella.streaming import drifting, minibatch
from tessella.streaming import state as stream

SCHEMA = "customer_id string, event_type string, value double, ts timestamp, seq long"
AS_OF = "2026-02-01"


def rows(n, value=1000.0):
    day = datetime.datetime(2026, 1, 10)
    return [(f"c{i % 3}", "purchase", value, day + datetime.timedelta(hours=i), i) for i in range(n)]


def test_stream_ends_in_the_state_that_the_batch_gives(spark, tmp_path):
    events = spark.createDataFrame(rows(30), SCHEMA)
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    found = {}

    def sink(batch, number):
        found.update({r.customer_id: (r.frequency, r.monetary, r.recency, r.segment) for r in batch.collect()})

    running = stream.start_states(event_stream(spark, f"{tmp_path}/in", SCHEMA, 1), AS_OF, sink, f"{tmp_path}/checkpoint")
    running.awaitTermination()
    want = {r.customer_id: (r.frequency, r.monetary, r.recency, r.segment) for r in stream.labelled(stream.state(events, AS_OF)).collect()}
    assert found == want and len(want) == 3


def test_windows_and_sessions(spark):
    events = spark.createDataFrame(rows(6), SCHEMA)
    assert stream.window_stats(events, "day").collect()[0]["count"] == 6
    assert stream.sessions(events, "2 hours").count() == 6
    assert stream.sessions(events, "4 hours").count() == 3
    assert {r.rate for r in stream.event_rate(events, 3600).collect()} == {3600 / 18.0}


def test_recluster_arms_then_fires_on_drift(spark):
    held = {"events": spark.createDataFrame(rows(60), SCHEMA)}
    sink = stream.Recluster(lambda: stream.state(held["events"].withColumn("customer_id", F.col("seq").cast("string")), AS_OF), k=2, least_customers=5)
    assert sink.check() is None
    assert sink(None, 0) is None and sink.baseline is not None
    assert sink(None, 1) is None
    held["events"] = spark.createDataFrame(rows(60, 90_000.0), SCHEMA)
    labels = sink(None, 2)
    assert labels is not None and {r.segment for r in labels.collect()} <= {"cluster_0", "cluster_1"}
    assert sink.history[0]["drifted"] == ["monetary"]


def test_a_batch_that_runs_again_counts_once_and_a_new_session_goes_on(spark, tmp_path):
    points = [spark.createDataFrame([([float(i), float(i % 3)],) for i in range(a, a + 20)], "features array<double>") for a in (0, 30, 60)]
    sink = minibatch.VersionedMiniBatch(spark, f"file://{tmp_path}/m", 2)
    for k, batch in enumerate(points):
        sink(batch, k)
    want = sink.model()
    for k in (1, 2, 2):
        minibatch.VersionedMiniBatch(spark, f"file://{tmp_path}/m", 2)(points[k], k)
    got = sink.model()
    assert (got.centres, got.counts) == (want.centres, want.counts) and sum(got.counts) == 40


def test_sketches_and_replay_of_a_watched_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    def batch(part):
        rows = spark.range(60).select(F.col("id").alias("customer_id"), (F.col("id") + 60 * part).alias("seq"), F.lit(1.7e9 + 86_400.0 * part).alias("ts"), F.lit(part + 1).cast("bigint").alias("frequency"), (F.col("id") * 10.0 + 1 + 5_000.0 * part).alias("monetary"))
        before = {"before_ts": F.lit(1.7e9 + 86_400.0 * (part - 1)), "before_frequency": F.lit(part).cast("bigint"), "before_monetary": F.col("monetary") - 5_000.0}
        return rows.withColumns({c: v if part else F.lit(None).cast("double") for c, v in before.items()})

    watch = drifting.Watch(spark, f"file://{tmp_path}/w", AS_OF, k=2)
    for number in (0, 1, 1):
        watch(batch(number), number)
    log = {r.feature: r for r in watch.table("log").where("batch = 1").collect()}
    assert log["frequency"].drift_score == 1.0 and log["monetary"].severity == "critical" and log["monetary"].fired
    assert watch.table("labels").count() == 60 and watch.baseline(2) == 1 and log["recency"].customers == 60
    assert drifting.scores(watch.table("sketches"), 1, 1)["frequency"] == 0.0
