"""Registered queries against the SQL that must give the same rows."""

import os

import duckdb
import pytest

import __spark_entry__
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ("rfm_segment8", "segment13_profiles", "churn_predictions", "clv_simple", "cohort_retention_points", "lifecycle_transitions", "drift_ks", "profile_statistics", "lookalike_cosine", "k_anonymity_check_5", "price_elasticity", "revenue_concentration", "size_forecast", "history_replay", "rules_classify_all", "stream_hourly_stats", "kmeans_assign", "dbscan_clusters", "tam", "stable_ids", "stream_batches", "mini_batches", "rules_sql_export", "activation_payloads", "stream_keyed_updates", "stream_recluster", "drift_kl", "drift_chi_square_numbers", "similar_all", "account_forest", "history_months", "basket_affinity", "record_sink", "privacy_ledger", "stream_mini_batches", "feature_provenance", "noise_laplace", "noise_gaussian", "kmeans_fit", "kprototypes_fit", "k_estimates", "stream_updates")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def tidy(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, list):
        return tuple(map(tidy, v))
    return v


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, duck, name):
    frame = __spark_entry__.queries()[name](spark, SMALL)
    columns = sorted(frame.columns)
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(want.columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    rows = duck.sql(f"SELECT {listed} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    got = [tuple(tidy(v) for v in r) for r in frame.select(*[f"`{c}`" for c in columns]).collect()]
    assert sorted(got, key=repr) == sorted((tuple(tidy(v) for v in r) for r in rows), key=repr)


@pytest.mark.skipif("ALL_SQL" not in os.environ, reason="takes minutes; set ALL_SQL to run")
@pytest.mark.parametrize("name", sorted(set(__spark_entry__.oracle_sql()) - set(SOME)))
def test_every_other_query_equals_its_sql(spark, duck, name):
    test_query_equals_its_sql(spark, duck, name)


def test_patterns_of_segments():
    """No triple stands for two segments, and all are scores; the SQL takes the library's own list, so it can't show that."""
    from tessella.operators.segments import PATTERNS

    assert {"Champions", "Loyal Customers", "At Risk"} <= set(PATTERNS)
    assert all(1 <= x <= 5 for triples in PATTERNS.values() for t in triples for x in t)
    seen = [t for triples in PATTERNS.values() for t in triples]
    assert len(set(seen)) == len(seen)


def test_registry():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) > 150
    assert len([q for q in queries if not q.startswith(("op", "pipeline"))]) > 160


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 150
