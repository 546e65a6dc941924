"""Density clusters, the exact silhouette and network training against plain computations."""

import math
import random

import numpy as np
import pytest

from tessella.operators import clustering, learning

SCHEMA = "id long, features array<double>"


def plain_dbscan(points, eps, least):
    near = {a: [b for b, y in points if math.dist(x, y) <= eps] for a, x in points}
    core = {a for a, n in near.items() if len(n) >= least}
    root = {}
    for start in sorted(core):
        if start in root:
            continue
        todo = [start]
        while todo:
            at = todo.pop()
            if at not in root:
                root[at] = start
                todo += [b for b in near[at] if b in core]
    number = {r: i + 1 for i, r in enumerate(sorted(set(root.values())))}
    return {a: number[root[a]] if a in core else min((number[root[b]] for b in near[a] if b in core), default=None) for a, _ in points}


def shaped(kind):
    chance = random.Random(kind)
    if kind == "scattered":
        return [(i, [chance.uniform(0, 12), chance.uniform(-6, 6)]) for i in range(160)]
    if kind == "three axes":
        return [(i, [chance.uniform(0, 4) for _ in range(3)]) for i in range(150)]
    if kind == "copies":
        return [(i, [1.0, 1.0] if i % 3 == 0 else [chance.choice([0.0, 2.0, 2.5]), chance.choice([0.0, 1.0, 9.0])]) for i in range(120)]
    if kind == "one axis":
        return [(i, [float(chance.randrange(60))]) for i in range(40)]
    # Two dense rings whose gap is next to eps.
    return [(i, [math.cos(i) * (1 if i % 2 else 2.02), math.sin(i) * (1 if i % 2 else 2.02)]) for i in range(200)]


@pytest.mark.parametrize(("kind", "compared"), [("scattered", 10_000), ("three axes", 10_000), ("copies", 4), ("one axis", 4), ("rings", 4)])
def test_density_clusters_equal_the_plain_ones(spark, monkeypatch, kind, compared):
    monkeypatch.setattr(clustering, "COMPARED", compared)
    points = shaped(kind)
    rows = spark.createDataFrame(points, SCHEMA)
    assert {r.id: r.cluster for r in clustering.dbscan(rows, 1.0, 4).collect()} == plain_dbscan(points, 1.0, 4)


def test_a_dense_cell_costs_its_points(spark):
    """A third of all points on two spots: pairs would be 10^10."""
    rows = spark.range(300_000).selectExpr("id", "case when id % 3 = 0 then array(0.1 * (id % 2), 0D) else array(10D + id, 5D) end AS features").selectExpr("id", "cast(features as array<double>) AS features")
    found = {r.cluster: r["count"] for r in clustering.dbscan(rows, 0.5, 5).groupBy("cluster").count().collect()}
    assert found == {1: 100_000, None: 200_000}


def test_density_without_core_points_or_width(spark):
    rows = spark.createDataFrame([(1, [0.0]), (2, [9.0])], SCHEMA)
    assert {r.cluster for r in clustering.dbscan(rows, 1.0, 2).collect()} == {None}
    with pytest.raises(ValueError):
        clustering.dbscan(rows, 0.0, 2)


@pytest.mark.parametrize("numbers", [8_000, 60])
def test_silhouette_equals_the_plain_one(spark, monkeypatch, numbers):
    monkeypatch.setattr(clustering, "PAIRED_NUMBERS", numbers)
    chance = random.Random(4)
    points = [(i, [chance.gauss(3 * (i % 3), 1), chance.gauss(0, 1)], i % 3 if i else 7) for i in range(90)]
    scores = []
    for a, x, c in points:
        gaps = {}
        for b, y, d in points:
            if a != b:
                gaps.setdefault(d, []).append(math.dist(x, y))
        own = np.mean(gaps[c]) if c in gaps else 0.0
        other = min(np.mean(v) for d, v in gaps.items() if d != c)
        scores.append((other - own) / max(own, other))
    rows = spark.createDataFrame([*points, (99, [0.0, 0.0], None)], f"{SCHEMA}, cluster int")
    assert clustering.silhouette(rows).first().silhouette == pytest.approx(np.mean(scores))
    assert clustering.silhouette(rows.where("id = 1"), alone=0.0).first().silhouette == 0.0


def test_training_in_stretches_equals_training_at_once(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [i / 10, 1.0], [0.5 * i / 10]) for i in range(23)], "seq int, x array<double>, y array<double>")
    plain = learning.Network(2, 1, (3,), epochs=2)
    for _ in range(2):
        loss = sum(plain.step(np.array([i / 10, 1.0]), np.array([0.5 * i / 10])) for i in range(23)) / 23
    monkeypatch.setattr(learning, "STRETCH", 7)
    net = learning.Network(2, 1, (3,), epochs=2)
    assert net.train(rows.repartition(3))["final_loss"] == pytest.approx(loss, rel=1e-12)
    assert all(np.allclose(a.weights, b.weights, rtol=1e-12) and np.allclose(a.biases, b.biases, rtol=1e-12) for a, b in zip(net.layers, plain.layers, strict=True))
    with pytest.raises(ValueError):
        net.train(rows.where("seq < 0"))


def test_density_clusters_over_many_axes(spark, monkeypatch):
    """By a tree of boxes with small leaves as by comparing all pairs; repeated points, equal coordinates and odd scales too."""
    monkeypatch.setattr(clustering, "LEAF", 4)
    monkeypatch.setattr(clustering, "LEVELS", 2)
    chance = random.Random(11)
    width, eps, least = 7, 1.1, 4
    points = [[chance.gauss(4 * (i % 3), 0.35) if j < 5 else (float(i % 2) if j == 5 else 100.0) for j in range(width)] for i in range(120)]
    points += [list(points[0])] * 5 + [[chance.uniform(-20, 20) for _ in range(width)] for _ in range(20)]
    rows = list(enumerate(points))
    want = plain_dbscan(rows, eps, least)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert {1, 2, None} <= set(want.values())
    for spelled in (16, 4):
        monkeypatch.setattr(clustering, "SPELLED", spelled)
        assert {r.id: r.cluster for r in clustering.dbscan(frame, eps, least).collect()} == want


def test_points_that_are_no_numbers_are_refused(spark):
    for bad in ([1.0, float("nan")], [None, 1.0]):
        rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, bad)], "id int, features array<double>")
        for run in (lambda r: clustering.dbscan(r, 1.0, 1), lambda r: clustering.estimate_k(r, 1, 2), lambda r: clustering.soft_clusters(r, 1, 1)):
            with pytest.raises(Exception, match="finite numbers"):
                run(rows)


def test_report_by_sums_or_by_all_pairs(spark):
    rows = spark.createDataFrame([(i, [float(i % 2) * 10 + i * 0.1, 0.0], i % 2) for i in range(12)], "id int, features array<double>, cluster int")
    centres = [[0.5, 0.0], [10.6, 0.0]]
    fast, exact = (clustering.quality_report(rows, centres, exact=e).first() for e in (False, True))
    assert fast.silhouette > exact.silhouette == pytest.approx(clustering.silhouette(rows).first().silhouette)
    assert (fast.inertia, fast.n_clusters, fast.davies_bouldin) == (exact.inertia, exact.n_clusters, exact.davies_bouldin)


@pytest.mark.parametrize(("most", "at_once"), [(8_192, 256), (9, 5)])
def test_scattered_points_are_compared_leaf_by_leaf(spark, monkeypatch, most, at_once):
    """Without a row for each pair of cells; far from the origin, at eps exactly, copies and border points too."""

    def no_cells(*_):
        raise AssertionError("cells meet in rows")

    monkeypatch.setattr(clustering, "_touching", no_cells)
    monkeypatch.setattr(clustering, "LEAF", 8)
    monkeypatch.setattr(clustering, "LEAF_POINTS", most)
    monkeypatch.setattr(clustering, "AT_ONCE", at_once)
    chance = random.Random(5)
    near = [[chance.gauss(3 * (i % 2), 0.6) for _ in range(5)] for i in range(60)]
    steps = [[1e8 + 0.5 * chance.randrange(4) for _ in range(5)] for _ in range(40)]
    rows = list(enumerate(near + steps + [near[0]] * 3 + [[chance.uniform(-9, 9) for _ in range(5)] for _ in range(15)]))
    frame = spark.createDataFrame(rows, SCHEMA)
    want = plain_dbscan(rows, 1.0, 4)
    core = {a for a, x in rows if sum(math.dist(x, y) <= 1.0 for _, y in rows) >= 4}
    assert {1, 2, None} <= set(want.values()) and any(c and a not in core for a, c in want.items())
    assert {r.id: r.cluster for r in clustering.dbscan(frame, 1.0, 4).collect()} == want
    assert {r.id for r in clustering.core_points(frame, 1.0, 4).collect()} == core


def test_silhouette_broadcasts_no_blocks(spark):
    """Each block meets each, so a side of that join has the points as often as there are blocks; a broadcast would bring it to the driver."""
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0], i % 3) for i in range(60)], "id int, features array<double>, cluster int")
    plan = clustering.silhouette(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [block" in plan and "BroadcastHashJoin [block" not in plan
