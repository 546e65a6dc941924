"""Draws by key: noise that reruns agree on, and what it is spread like."""

import math

import pytest
from pyspark.sql import functions as F

from tessella.functions.draws import uniform
from tessella.functions.ranges import preceding
from tessella.operators import learning, privacy
from tessella.streaming import state


def test_uniform_is_even_and_told_by_key_and_salt(spark):
    rows = spark.range(4000)
    one, other = (rows.select("id", uniform(F.col("id"), *s).alias("u")) for s in ((1,), (2,)))
    tens = {r.t: r.n for r in one.groupBy(F.floor(F.col("u") * 10).alias("t")).agg(F.count("*").alias("n")).collect()}
    assert set(tens) == set(range(10)) and all(abs(n - 400) < 100 for n in tens.values())
    assert one.join(other, ["id", "u"]).count() == 0
    assert 0 < spark.range(1).select(uniform(F.lit(None), 1).alias("u")).first().u < 1


def test_noise_by_key_doesnt_depend_on_how_rows_are_dealt(spark):
    rows = spark.range(3000).select("id", F.lit(1e6).alias("x"))
    for noisy, deviation in ((privacy.laplace(F.col("x"), 0.5, 2.0, 9, F.col("id")), 4 * math.sqrt(2)), (privacy.gaussian(F.col("x"), 1.0, 1e-5, 2.0, 9, F.col("id")), 2 * math.sqrt(2 * math.log(1.25e5)))):
        a, b = ({r.id: r.y for r in d.select("id", noisy.alias("y")).collect()} for d in (rows, rows.repartition(7).orderBy(F.desc("id"))))
        assert a == b
        gaps = [y - 1e6 for y in a.values()]
        mean = sum(gaps) / len(gaps)
        assert abs(mean) < deviation / 10
        assert abs(math.sqrt(sum((g - mean) ** 2 for g in gaps) / len(gaps)) / deviation - 1) < 0.1


def test_row_before_across_ranges(spark):
    """One key with most rows, a null key, null values and a key of one row."""
    rows = [("hot", i, None if i % 5 == 0 else i * 10) for i in range(200)] + [(None, 1, 7), (None, 3, 8), ("one", 4, 9)]
    frame = spark.createDataFrame(rows, "k string, seq int, v int").repartition(5)
    got = {(r.k, r.seq): r.before for r in preceding(frame, ["k"], "seq", {"before": "v"}).collect()}
    want, last = {}, {}
    for k, seq, v in rows:
        want[k, seq] = last.get(k)
        last[k] = v
    assert got == want


@pytest.mark.parametrize("most", [0, state.ONE_TASK])
def test_updates_of_one_customer_with_most_events(spark, monkeypatch, most):
    monkeypatch.setattr(state, "ONE_TASK", most)
    """Labels before and after each event, step by step; a null value adds nothing."""
    rows = [(1, i, "2024-01-01 00:00:00", None if i % 7 == 0 else 900.0 * (i % 3)) for i in range(150)] + [(2, 5, "2024-01-05 00:00:00", 3.0)]
    frame = spark.createDataFrame(rows, "customer_id int, seq int, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp")).repartition(6)
    got = {(r.customer_id, r.seq): (r.previous_segment, r.new_segment, r.changed) for r in state.updates(frame, "2024-01-11").collect()}

    def label(days, n, total):
        mean = ((100 - min(days, 100)) + min(n, 100) + min(total / 1000, 100)) / 3
        return next((name for least, name in ((80, "Champions"), (60, "Loyal Customers"), (40, "Potential Loyalists"), (20, "At Risk")) if mean >= least), "Lost")

    total, before, want = 0.0, None, {}
    for i in range(150):
        total += rows[i][3] or 0.0
        now = label(10, i + 1, total)
        want[1, i], before = (before, now, before != now), now
    want[2, 5] = (None, label(6, 1, 3.0), True)
    assert got == want


def test_recurrent_states_over_batches(spark):
    """A key over several batches, a null key and one that comes after it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = [(k, i, [0.5, i / 10]) for k in ("a", None, "b") for i in range(35)]
        frame = spark.createDataFrame(rows, "k string, seq int, x array<double>").repartition(4)
        got = {(r.k, r.seq): r.h for r in learning.recurrent_states(frame, "k", 2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 105
    for k in ("a", None, "b"):
        h = 0.0
        for i in range(35):
            h = math.tanh(0.1 * (0.5 + i / 10) + 0.1 * 2 * h)
            assert all(abs(v - h) < 1e-12 for v in got[k, i])
