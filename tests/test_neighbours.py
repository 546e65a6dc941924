import numpy as np
import pytest

from tessella.operators import neighbours

S = "id long, features array<double>"


def plain(rows, queries, n, metric):
    out = []
    for q, a in queries:
        found = []
        for i, b in rows:
            if i != q:
                x, y = np.array(a), np.array(b)
                if metric == "cosine":
                    norm = np.linalg.norm(x) * np.linalg.norm(y)
                    s = float(x @ y / norm) if norm else 0.0
                else:
                    s = 1 - min(float(np.linalg.norm(x - y)) / 100, 1)
                found.append((-round(s, 9), i))
        out += [(q, i, round(-s, 7), k + 1) for k, (s, i) in enumerate(sorted(found)[:n])]
    return out


def got(frame):
    return sorted((r.query_id, r.id, round(r.similarity, 7), r.place) for r in frame.collect())


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_equals_brute_force(spark, metric):
    chance = np.random.default_rng(2)
    centres = chance.normal(size=(6, 5)) * 4
    rows = [(i, (centres[i % 6] + chance.normal(size=5)).tolist()) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(20)] + [(430, [0.0] * 5), (431, [0.0] * 5)]  # copies and zero vectors
    df = spark.createDataFrame(rows, S)
    queries = [r for r in rows if r[0] % 7 == 0 or r[0] == 430]
    asked = spark.createDataFrame(queries, S)
    assert got(neighbours.top_n(asked, df, 6, metric, pivots=8, block=16, chunk=10)) == sorted(plain(rows, queries, 6, metric))


def test_rings_are_pruned_and_nothing_is_a_cross_join(spark):
    chance = np.random.default_rng(1)
    rows = [(i, (np.eye(8)[i % 8] * 30 + chance.normal(size=8) * 0.1).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, S)
    found = neighbours.top_n(df.where("id < 50"), df, 3, "euclidean", pivots=16, block=50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert got(found) == sorted(plain(rows, rows[:50], 3, "euclidean"))


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (None, [1.0, 1.0]), (4, []), (5, [1.0, None]), (6, [1.0, 1.0])], S)
    assert [(r.query_id, r.id) for r in neighbours.top_n(df, df, 5).orderBy("query_id", "place").collect()] == [(1, 6), (1, 2), (2, 6), (2, 1), (6, 1), (6, 2)]
    assert neighbours.top_n(df.limit(0), df, 5).count() == 0
    assert neighbours.top_n(df, df.limit(0), 5).count() == 0
