"""Cases worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tessella.operators import accounts, activation, clustering, drift, learning, lookalike, patterns, pricing, privacy, profiling, rules, segments, temporal, value


def one(spark, cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


def test_simple_ltv(spark):
    got = one(spark, value.simple_ltv(F.lit(1000.0), F.lit(10), F.lit(365), F.lit(730.0)))
    assert got["annual_value"] == 1000 and got["predicted_ltv"] == 2000 and got["predicted_ltv_3yr"] == 2550 and got["predicted_ltv_5yr"] == pytest.approx(3500)
    assert got["churn_probability"] == pytest.approx(0.08)
    idle = one(spark, value.simple_ltv(F.lit(70.0), F.lit(0), F.lit(10), F.lit(730.0)))
    assert idle["predicted_ltv"] == 70 and idle["confidence_score"] == 0.3 and idle["churn_probability"] == 0.5


def test_size_forecast(spark):
    points = spark.createDataFrame([("a", 0.0, 100.0), ("a", 10.0, 200.0), ("b", 0.0, 100.0), ("b", 10.0, 100.0), ("c", 1.0, 5.0)], "k string, x double, y double")
    got = {(r.k, r.step): r for r in temporal.size_forecast(points, ["k"], 3).collect()}
    assert [round(got["a", i].predicted, 6) for i in (1, 2, 3)] == [210, 220, 230]
    assert [round(got["a", i].lower, 6) for i in (1, 2, 3)] == [189, 198, 207]
    assert got["a", 1].trend_type == "growth" and got["a", 1].r_squared == pytest.approx(1)
    assert got["b", 1].predicted == 100 and got["b", 1].trend_type == "stable" and got["b", 1].r_squared == 0
    assert ("c", 1) not in got


def test_momentum(spark):
    series = spark.createDataFrame([("a", i, float(10 * (i + 1))) for i in range(5)] + [("b", 0, 1.0)], "k string, t int, x double")
    (r,) = temporal.momentum(series, ["k"], 3).collect()
    assert (r.momentum_score, r.acceleration, r.trend_strength) == (20, 0, "strong")
    assert r.continuation_probability == pytest.approx(0.8) and r.reversal_risk == pytest.approx(0.2)


def test_replay(spark):
    events = spark.createDataFrame([("s", 0, "2026-01-01", "added", "a"), ("s", 1, "2026-01-02", "added", "b"), ("s", 2, "2026-01-03", "removed", "a"), ("s", 3, "2026-02-01", "added", "c")], "segment string, seq int, date string, kind string, member string")
    assert [r.member for r in temporal.replayed(events, "2026-01-31").collect()] == ["b"]


def test_k_anonymity(spark):
    rows = spark.createDataFrame([("20s", "f"), ("20s", "f"), ("30s", None)], "age string, sex string")
    got = privacy.check(rows, ["age", "sex"], 2).first()
    assert not got.is_anonymized and got.suppressed_rows == 1 and got.generalized_rows == 2
    assert privacy.suppressed(rows, ["age", "sex"], 2).count() == 2
    assert privacy.check(rows.limit(0), ["age", "sex"], 2).first().is_anonymized


def test_budget_and_noise(spark):
    budget = privacy.Budget(1.0)
    assert budget.consume(0.6) and not budget.consume(0.6) and budget.percentage == pytest.approx(60)
    noisy = spark.range(200).select(privacy.laplace(F.lit(1.0), 1.0, 1.0, 3).alias("a"), privacy.gaussian(F.lit(1.0), 1.0, 1e-5, 1.0, 3).alias("b")).collect()
    assert all(r.a >= 0 and r.b >= 0 for r in noisy) and len({r.a for r in noisy}) > 100


def test_drift(spark):
    apart = spark.createDataFrame([("f", 0, float(x)) for x in (1, 2, 3)] + [("f", 1, float(x)) for x in (100, 200, 300)], "feature string, side int, x double")
    assert drift.kolmogorov_smirnov(apart, ["feature"]).first().drift_score == 1.0
    assert drift.hellinger(apart, ["feature"]).first().drift_score > 0.9
    assert one(spark, {"s": drift.severity(F.lit(1.0)), "r": drift.severity_rank(F.lit("high"))}) == {"s": "critical", "r": 3}


def test_segments_and_export():
    text = segments.export_sql("Champions", "postgres", "crm.customers")
    assert text == "SELECT customer_id, 'Champions' AS segment\nFROM crm.customers\nWHERE (recency_score = 5 AND frequency_score = 5 AND monetary_score IN (5, 4)) OR (recency_score = 5 AND frequency_score = 4 AND monetary_score = 5) OR (recency_score = 4 AND frequency_score = 5 AND monetary_score = 5);"
    assert "recency_score=5" in segments.export_sql("VIP", "oracle", "t") and " AS customer_id," in segments.export_sql("VIP", "bigquery", "t")
    for bad in ("t; DROP TABLE x", "", "1t", "a.b-c", "a b"):
        with pytest.raises(ValueError):
            segments.export_sql("VIP", "ansi", bad)
    with pytest.raises(ValueError):
        segments.export_sql("Nobody", "ansi", "t")
    with pytest.raises(ValueError):
        segments.dialect("cobol")


def test_every_triple_has_the_segment_of_its_pattern(spark):
    r, f, m = (F.col(c) for c in "rfm")
    rows = spark.createDataFrame([(a, b, c) for a in range(1, 6) for b in range(1, 6) for c in range(1, 6)], "r int, f int, m int")
    got = {(x.r, x.f, x.m): x.s for x in rows.withColumn("s", segments.segment13(r, f, m)).collect()}
    for name, patterns_ in segments.PATTERNS.items():
        assert {got[p] for p in patterns_} == {name}
    assert got[5, 5, 1] == "VIP" and got[3, 3, 3] == "Need Attention"


def test_rules(spark):
    c = rules.Condition
    rule = rules.Rule("r", (c("x", ">", 1.0), c("y", "=", 2.0)), "OR")
    rows = spark.createDataFrame([(5.0, None), (0.0, 2.0), (None, None)], "x double, y double")
    assert [r.s for r in rows.select(rules.Segment("s", (rule,)).column().alias("s")).collect()] == [True, True, False]
    assert [r.s for r in rows.select(rules.Rule("n", (c("x", ">", 1.0),), "NOT").column().alias("s")).collect()] == [False, True, True]
    assert rules.Segment("s", (rule,)).sql() == "((x > 1.0 OR y = 2.0))"
    with pytest.raises(ValueError):
        c("x; --", ">", 1.0)
    texts = spark.createDataFrame([("web shop",), ("store",)], "t string")
    assert [r.s for r in texts.select(c("t", "contains", "web").column().alias("s")).collect()] == [True, False]


def test_lookalikes(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0], float(i)) for i in range(10)], "customer_id long, features array<double>, ltv double")
    got = lookalike.audience(rows, rows.where("customer_id = 9"), "cosine", 0.8).collect()
    assert {r.customer_id for r in got} == {7, 8, 9}
    assert one(spark, {"j": lookalike.jaccard(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("1")))})["j"] == 0.5


def test_pricing(spark):
    got = one(spark, pricing.cac(F.lit(1000.0), F.lit(10), F.lit(50.0)))
    assert got == {"cac": 100.0, "payback_months": 2.0, "efficiency": pytest.approx(10 / 12)}
    got = one(spark, pricing.roi(F.lit(300.0), F.lit(100.0)))
    assert got["roi_percentage"] == 200 and got["risk"] == "low"
    assert one(spark, pricing.roi(F.lit(0.0), F.lit(0.0)))["payback_days"] == 10_000


def test_trend_and_profile_measures(spark):
    series = spark.createDataFrame([("a", i, float(i)) for i in range(6)], "k string, t int, x double")
    r = patterns.trend(series, ["k"]).first()
    assert r.trend_direction == "increasing" and r.trend_strength == 1.0 and r.moving_average == 4.5
    counts = spark.createDataFrame([("s", 1), ("s", 1), ("t", 4)], "segment string, n long")
    got = {r.segment: r for r in profiling.entropy(counts).collect()}
    assert got["s"].shannon_entropy == 1.0 and got["s"].gini_coefficient == 0 and got["t"].gini_coefficient is None
    assert one(spark, {"c": profiling.membership_confidence(F.lit(1.0), F.lit(3.0))})["c"] == 0.75


def test_blobs_are_told_apart(spark):
    rows = spark.createDataFrame([(i, [1.0 + i % 3 / 10, 1.0]) for i in range(9)] + [(10 + i, [10.0, 10.0 + i % 2]) for i in range(8)], "id long, features array<double>")
    model = clustering.fit_kmeans(rows, 2)
    labels = {r.id: r.cluster for r in model.transform(rows).collect()}
    assert len({labels[i] for i in range(9)}) == 1 and labels[0] != labels[10]
    assert model.inertia == pytest.approx(clustering.fit_strided(rows, 2).inertia)
    with pytest.raises(ValueError):
        clustering.fit_kmeans(rows, 99)
    batch = clustering.MiniBatch(2).partial_fit(rows).partial_fit(rows)
    assert sum(batch.counts) == 17
    found = {r.id: r.cluster for r in clustering.dbscan(rows, 1.5, 3).collect()}
    assert found[0] == 1 and found[10] == 2
    scored = model.transform(rows)
    assert clustering.silhouette(scored).first().silhouette > 0.8
    assert clustering.agreement(scored.select(F.col("cluster").alias("a"), F.col("cluster").alias("b"))).first().adjusted_rand_index == 1.0


def test_network(spark):
    rows = spark.createDataFrame([(i, [i / 10, 1.0], [0.5 * i / 10]) for i in range(10)], "seq int, x array<double>, y array<double>")
    net = learning.Network(2, 1, (3,), epochs=200, rate=0.05)
    first = learning.Network(2, 1, (3,), epochs=1, rate=0.05).train(rows)["final_loss"]
    assert net.train(rows)["final_loss"] < first / 2
    assert net.info()[0] == "Input: 2" and len(net.info()) == 3
    assert net.predict(rows).count() == 10
    with pytest.raises(RuntimeError):
        learning.Preprocessing(("x",)).transform(rows)
    with pytest.raises(ValueError):
        learning.Preprocessing()


def test_preprocessing_reuses_what_it_fitted(spark):
    rows = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, None), (2.0, "a")], "x double, c string")
    made = learning.Preprocessing(("x",), ("c",)).fit(rows)
    got = [r.features for r in made.transform(spark.createDataFrame([(2.0, "z"), (None, None)], "x double, c string")).collect()]
    assert got == [[0.0, 0.0, 0.0], [0.0, 1.0, 0.0]]


def test_records(spark):
    rows = spark.createDataFrame([("VIP", "rfm", "c1", 1.0), ("VIP", "rfm", "a@b", 1.0), ("VIP", "rfm", " ", 1.0), ("VIP", "x", "c", 1.0)], "segment string, segment_type string, customer_id string, score double")
    good, refused = activation.membership_records(rows)
    assert good.count() == 1 and refused.count() == 3
    import hashlib

    want = "seg_" + hashlib.sha256(b"VIP\x1frfm\x1f").hexdigest()[:24]
    assert good.first().segmentId == want
    a, b = (activation.batched(good, "membershipId").first().idempotency_key for _ in range(2))
    assert a == b and len(a) == 64
    with pytest.raises(ValueError):
        activation.batched(good, "membershipId", 0)


def test_permissions_and_health(spark):
    p = accounts.Permissions()
    assert p.check("Admin", "Delete", "Settings") and p.check("Viewer", "View", "Segment") and not p.check("Viewer", "Edit", "Segment")
    p.revoke("Viewer", "View", "Segment")
    assert not p.check("Viewer", "View", "Segment")
    assert one(spark, {"h": accounts.health_label(F.lit(0.8)), "s": accounts.company_size(F.lit(51))}) == {"h": "healthy", "s": "mid_market"}
    assert not math.isnan(one(spark, accounts.account_score(F.lit(0.5), F.lit(0.5), F.lit(1.0), F.lit(0.0)))["health_score"])
