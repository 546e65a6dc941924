"""Checks of input values, and what the reports say."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import checks
from tessella.functions.ranges import quarters
from tessella.operators import accounts, clustering, learning, profiling


@pytest.mark.parametrize("bad", [[1.0, float("nan")], [float("inf")], [-float("inf"), 2.0], [None, 1.0], [], None])
def test_vectors_must_be_finite(spark, bad):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, bad)], "id long, features array<double>")
    with pytest.raises(Exception, match="must be finite"):
        rows.select(checks.finite(F.col("features"))).collect()
    with pytest.raises(Exception, match="must be finite"):
        clustering.fit_kmeans(rows, 1)


def test_numbers_must_be_in_range(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,)], "x double")
    assert [r[0] for r in rows.select(checks.within(F.col("x"), 0, 1, "share")).collect()] == [0.0, 1.0]
    for bad in (None, 1.5, float("nan")):
        with pytest.raises(Exception, match="share must be from 0 to 1"):
            spark.createDataFrame([(bad,)], "x double").select(checks.within(F.col("x"), 0, 1, "share")).collect()
    checks.settings(1, 1)
    with pytest.raises(ValueError, match="cluster"):
        checks.settings(0, 90)
    with pytest.raises(ValueError, match="window"):
        checks.settings(4, 0)


def test_quarters_of_ties_and_null_keys(spark):
    rows = spark.createDataFrame([(None, float(i // 2)) for i in range(8)] + [("a", 3.0), ("b", None), ("a", None)], "k string, x double")
    got = {r.k: r for r in quarters(rows, ["k"]).collect()}
    assert (got[None].n, got[None].median, got[None].p25, got[None].p75) == (8, 1.5, 1.0, 3.0)
    assert (got["a"].n, got["a"].median, got["a"].p25, got["a"].p75) == (1, 3.0, 3.0, 3.0) and "b" not in got
    whole = quarters(rows, []).first()
    assert whole.n == 9 and whole.median == 2.0
    assert quarters(rows.limit(0), ["k"]).count() == 0


def test_overall_score_counts_a_hundredth_of_the_ratio(spark):
    got = spark.range(1).select(clustering.quality_score(F.lit(0.5), F.lit(1.0), F.lit(300.0)).alias("a"), clustering.quality_score(F.lit(1.0), F.lit(20.0), F.lit(1e9)).alias("b")).first()
    assert got.a == pytest.approx((75 + 90 + 3) / 3) and got.b == pytest.approx(200 / 3)


def test_summary_of_the_strongest_driver(spark):
    rows = spark.createDataFrame([("s", "spend", 0.4, 9.0, 5.0), ("s", "visits", 0.2, 1.0, 5.0)], "segment string, feature string, importance double, value double, mean double")
    assert profiling.summaries(profiling.explained(rows)).first().summary == "Segment s is primarily characterized by elevated spend (importance: 100%, 100 of members affected)."


def test_next_steps(spark):
    rows = spark.createDataFrame([("a", 0.9, 0.5, 3, 1200.0)], "account_id string, adoption double, trend double, users long, arr double")
    got = {r.opportunity_type: r.recommended_actions for r in accounts.opportunities(rows).collect()}
    assert got == {k: list(accounts.NEXT_STEPS[k]) for k in ("cross_sell", "user_seat_upsell")}


def test_slopes_are_those_of_the_functions():
    import numpy as np

    x = np.array([-2.0, -0.3, 0.4, 1.7])
    for name, f in learning.ACTIVATIONS.items():
        assert np.allclose(learning.SLOPES[name](x), (f(x + 1e-6) - f(x - 1e-6)) / 2e-6, atol=1e-6), name


def test_names_in_other_spellings():
    from tessella.functions.names import known

    assert [known(*x) for x in (("event type", "Page_View"), ("drift method", "CHI2"), ("lifecycle stage", "AtRisk"), ("window", "Hour"), ("logical operator", "or"))] == ["pageview", "chi_square", "at_risk", "hour", "OR"]
    with pytest.raises(ValueError, match="there are minute, hour"):
        known("window", "year")
