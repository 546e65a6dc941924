import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions.gamma import upper_gamma
from tessella.operators import drift


@pytest.mark.parametrize("m", [1, 2, 5, 20])
def test_upper_gamma_equals_closed_forms(spark, m):
    xs = [0.0, 1e-6, 0.3, 1.0, m - 0.5, m + 1.0, 3.0 * m, 40.0, 300.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for x, got, half in df.select("x", upper_gamma(float(m), F.col("x")), upper_gamma(0.5, F.col("x"))).collect():
        assert got == pytest.approx(math.exp(-x) * sum(x**i / math.factorial(i) for i in range(m)), abs=1e-12)
        assert half == pytest.approx(math.erfc(math.sqrt(x)), abs=1e-12)


def test_divergences_of_equal_shifted_and_empty_sides(spark):
    chance = random.Random(1)
    rows = [(k, s, chance.gauss(shift * s, 1)) for k, shift in (("same", 0), ("moved", 2)) for s in (0, 1) for _ in range(400)]
    rows += [("ties", s, 1.0) for s in (0, 1) for _ in range(9)] + [("empty", 0, 1.0), ("nulls", 0, None), ("nulls", 1, None)]
    df = spark.createDataFrame(rows, "feature string, side int, x double")
    kl = {r.feature: r for r in drift.kullback_leibler(df, ["feature"]).collect()}
    chi = {r.feature: r for r in drift.chi_square_numbers(df, ["feature"]).collect()}
    assert kl["same"].drift_score < 0.25 < 0.7 < kl["moved"].drift_score < 1 and kl["ties"].divergence == kl["empty"].divergence == 0
    assert chi["same"].p_value > 0.001 > 1e-20 > chi["moved"].p_value and (chi["ties"].statistic, chi["ties"].p_value) == (0, 1)
    assert chi["same"].freedom == 10 and chi["empty"].drift_score == 0
    for method in drift.METHODS:
        assert {r.severity for r in drift.feature_drift(df.where("feature = 'moved'"), ["feature"], method).collect()} <= {"high", "critical"}
    stand_in = drift.feature_drift(df, ["feature"], "chi_square", stand_ins=True).collect()
    assert sorted((r.feature, r.drift_score) for r in stand_in) == sorted((r.feature, r.drift_score) for r in drift.kolmogorov_smirnov(df, ["feature"]).collect())
    with pytest.raises(ValueError):
        drift.feature_drift(df, ["feature"], "other")
