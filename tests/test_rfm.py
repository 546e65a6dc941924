from pyspark.sql import functions as F

from tessella.operators import rfm


def test_scores_put_the_largest_value_first(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 4, 3, 2, 1])], "id int, v double")
    got = rfm.positions(df, [F.col("v").desc(), F.col("id").asc()], "i").select("id", rfm.score(F.col("i"), F.lit(5), "quintile").alias("q"), rfm.score(F.col("i"), F.lit(5), "percentile").alias("p")).orderBy("id").collect()
    assert [r.q for r in got] == [1, 1, 2, 3, 4]
    assert [r.p for r in got] == [100, 80, 60, 40, 19]


def test_customer_without_dates_gets_zeros(spark):
    tx = spark.sql("SELECT 'a' AS customer_id, CAST(NULL AS TIMESTAMP) AS ts, 5.0D AS amount")
    assert rfm.base(tx, "2020-01-01").collect()[0][1:] == (0.0, 0.0, 0.0)


def test_empty_input_is_empty(spark):
    tx = spark.createDataFrame([], "customer_id string, ts timestamp, amount double")
    assert rfm.scored(rfm.base(tx, "2020-01-01")).count() == 0


def test_both_ways_of_ordering_agree(spark, monkeypatch):
    tx = spark.range(3000).selectExpr("id % 400 AS customer_id", "timestamp_seconds(1600000000 + (id * 7919) % 90000000) AS ts", "double((id * 31) % 97) AS amount")
    frame = rfm.base(tx, "2024-01-01")
    one = sorted(map(tuple, rfm.scored(frame).collect()))
    monkeypatch.setattr(rfm, "ONE_TASK", 0)
    assert sorted(map(tuple, rfm.scored(frame).collect())) == one
