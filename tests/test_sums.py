"""Sums of doubles in the order of the table, so that figures on a limit or on a half are those of the SQL."""

import duckdb
import pytest

import __spark_entry__
from tessella.functions.ranges import totals

LARGER = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", ["account_opportunities", "account_score"])
def test_figures_on_a_half_equal_the_sql(spark, name):
    duck = duckdb.connect()
    duck.execute("SET threads=1")
    for t in ("nation", "supplier", "lineitem"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{LARGER}/{t}.parquet'")
    frame = __spark_entry__.queries()[name](spark, LARGER)
    columns = ", ".join(frame.columns)
    flat = lambda rows: sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in rows), key=repr)
    assert flat(frame.collect()) == flat(duck.sql(f"SELECT {columns} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall())


def test_totals_follow_the_order_however_rows_are_dealt(spark):
    values = [1e16, 1.0, 1.0, -1e16, 0.1, 0.2, None, 0.3]
    rows = spark.createDataFrame([(k, i, x) for k in (1, None) for i, x in enumerate(values)], "k int, i int, x double")
    want = 0.0
    for x in values:
        want += x or 0.0
    for n in (1, 7):
        got = totals(rows.orderBy("x").repartition(n), ["k"], ["i"], {"s": "x"}).collect()
        assert sorted((str(r.k), r.n, r.s) for r in got) == [("1", 8, want), ("None", 8, want)]
