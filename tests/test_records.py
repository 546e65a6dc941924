import os

import pytest
from pyspark.sql import functions as F

from tessella.operators import activation
from tessella.sources import records


@pytest.fixture
def rows(spark):
    records.register(spark)
    made = spark.range(40).select(F.concat(F.lit("m"), F.lpad("id", 3, "0")).alias("membershipId"), F.col("id").alias("score"))
    return activation.batched(made, "membershipId", 8)


def save(df, path, mode="append"):
    df.write.format(records.NAME).option("path", path).mode(mode).save()


def read(spark, path):
    return sorted((r.batch, r.membershipId, r.score) for r in spark.read.format(records.NAME).option("path", path).load().collect())


def test_written_twice_is_read_once(spark, rows, tmp_path):
    path = f"file://{tmp_path}/out"
    want = sorted((r.batch, r.membershipId, r.score) for r in rows.collect())
    save(rows.where("batch < 3").repartition(3), path)
    save(rows.repartition(4), path)  # batches 0 to 2 again, and the others
    save(rows, path)
    assert read(spark, path) == want and len(want) == 40
    save(rows.where("batch = 1"), path, "overwrite")
    assert read(spark, path) == [r for r in want if r[0] == 1]


def test_a_failed_task_leaves_nothing_and_the_next_try_all(spark, rows, tmp_path):
    path, marker = f"file://{tmp_path}/out", f"{tmp_path}/failed"
    save(rows.where("batch = 0"), path)

    def once(batches):
        for b in batches:
            if 3 in set(b["batch"]) and not os.path.exists(marker):
                open(marker, "w").close()
                raise RuntimeError("this task fails once")
            yield b

    flaky = rows.repartition(4, "batch").mapInPandas(once, rows.schema)
    with pytest.raises(Exception, match="fails once"):
        save(flaky, path)
    assert len(read(spark, path)) == 8
    save(flaky, path)
    assert read(spark, path) == sorted((r.batch, r.membershipId, r.score) for r in rows.collect())


def test_columns_and_empty_tables(spark, rows, tmp_path):
    with pytest.raises(Exception, match="idempotency_key"):
        save(rows.drop("batch"), f"file://{tmp_path}/a")
    save(rows.limit(0), f"file://{tmp_path}/b")
    with pytest.raises(Exception, match="no records"):
        read(spark, f"file://{tmp_path}/b")
