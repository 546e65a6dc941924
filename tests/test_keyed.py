import datetime
import time

from pyspark.sql import functions as F

from tessella.sources.tables import event_stream
from tessella.streaming import keyed
from tessella.streaming import state as stream
from tests.conftest import SMALL

SCHEMA = "customer_id long, value double, ts timestamp, seq long"
AS_OF = "2026-02-01"
LABELS = ["customer_id", "seq", "previous_segment", "new_segment", "changed"]


def add(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def event(customer, seq, hours=0, value=1000.0):
    return (customer, value, datetime.datetime(2026, 1, 10) + datetime.timedelta(hours=hours), seq)


def run(spark, tmp_path, **options):
    rows = keyed.updates(event_stream(spark, f"{tmp_path}/in", SCHEMA, 1), AS_OF, **options)
    assert keyed.start(rows, f"{tmp_path}/checkpoint", f"{tmp_path}/out", **({"once": True} if options else {})).awaitTermination(60)
    return spark.read.parquet(f"{tmp_path}/out")


def test_micro_batches_and_restarts_give_what_one_pass_gives(spark, tmp_path):
    given = spark.read.parquet(f"{SMALL}/events.parquet").select(F.col("user_id").alias("customer_id"), "value", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    n = given.count()
    for k in range(4):  # each run starts from the checkpoint of the one before
        for half in range(2):
            low, high = (2 * k + half) * n // 8, (2 * k + half + 1) * n // 8
            given.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = run(spark, tmp_path)
    assert got.count() == n
    want = stream.updates(given, AS_OF)
    assert sorted(map(tuple, got.select(*LABELS).collect()), key=repr) == sorted(map(tuple, want.select(*LABELS).collect()), key=repr)


def test_late_events_are_marked_and_counted(spark, tmp_path):
    add(spark, [event(1, 0, 10), event(1, 1, 9.5)], f"{tmp_path}/in")
    run(spark, tmp_path)
    add(spark, [event(1, 2, 8), event(2, 3, 8), event(None, 4, 1)], f"{tmp_path}/in")
    got = {r.seq: r for r in run(spark, tmp_path).collect()}
    assert {s: r.late for s, r in got.items()} == {0: False, 1: False, 2: True, 3: False, 4: False}
    assert got[2].frequency == 3 and got[2].before_frequency == 2 and got[3].previous_segment is None and got[4].customer_id == -1


def test_state_expires(spark, tmp_path):
    add(spark, [event(1, 0)], f"{tmp_path}/in")
    run(spark, tmp_path, ttl_ms=1_000)
    time.sleep(1.5)
    add(spark, [event(1, 1)], f"{tmp_path}/in")
    assert [r.frequency for r in run(spark, tmp_path, ttl_ms=1_000).orderBy("seq").collect()] == [1, 1]


def test_events_wait_for_enough(spark, tmp_path):
    add(spark, [event(1, 0), event(1, 1), event(2, 2)], f"{tmp_path}/in")
    assert run(spark, tmp_path, hold=3, hold_ms=600_000).count() == 0
    add(spark, [event(1, 3)], f"{tmp_path}/in")
    assert [(r.seq, r.frequency) for r in run(spark, tmp_path, hold=3, hold_ms=600_000).orderBy("seq").collect()] == [(0, 1), (1, 2), (3, 3)]


def test_events_wait_for_the_time(spark, tmp_path):
    add(spark, [event(2, 2)], f"{tmp_path}/in")
    assert run(spark, tmp_path, hold=3, hold_ms=1).count() == 0
    add(spark, [event(3, 4)], f"{tmp_path}/in")  # its batch lets the timer of customer 2 go off
    assert [(r.seq, r.frequency) for r in run(spark, tmp_path, hold=3, hold_ms=1).collect()] == [(2, 1)]
