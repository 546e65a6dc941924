"""Forests, months of membership and baskets on made-up rows; the registered queries are held against SQL."""

import datetime
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessella.operators import baskets, graph, temporal


def test_forest_with_circles_and_missing_parents(spark):
    links = [(1, None, 1.0), (2, 1, 2.0), (3, 2, 4.0), (4, 99, 8.0), (5, 6, 1.0), (6, 5, 1.0), (7, 6, 1.0), (8, 8, 1.0), (9, None, None)] + [(100 + i, 99 + i if i else 3, 1.0) for i in range(40)]
    got = {r.node: (r.root, r.depth, r.total, r.cyclic) for r in graph.forest(spark.createDataFrame(links, "node long, parent long, value double")).collect()}
    assert got[1] == (1, 0, 47.0, False) and got[3] == (1, 2, 44.0, False) and got[139] == (1, 42, 1.0, False)
    assert got[4] == (99, 1, 8.0, False) and got[9] == (9, 0, 0.0, False)
    assert {n: got[n] for n in (5, 6, 7, 8)} == dict.fromkeys((5, 6, 7, 8), (None, None, None, True))
    assert graph.forest(spark.createDataFrame([], "node long, parent long, value double")).count() == 0


def test_forest_equals_walking_up(spark):
    chance = random.Random(6)
    links = [(i, chance.choice([None, *range(i)]) if i and chance.random() < 0.95 else None, float(i)) for i in range(300)]
    parent = {n: p for n, p, _ in links}
    want, total = {}, dict.fromkeys(parent, 0.0)
    for n in parent:
        at, depth = n, 0
        total[at] += n
        while parent[at] is not None:
            at, depth = parent[at], depth + 1
            total[at] += n
        want[n] = (at, depth)
    rows = graph.forest(spark.createDataFrame(links, "node long, parent long, value double")).collect()
    assert {r.node: (r.root, r.depth, r.total) for r in rows} == {n: (*want[n], total[n]) for n in parent}


def test_months_equal_replaying_each_date(spark):
    chance = random.Random(3)
    day = datetime.date(2024, 1, 1)
    events = [(f"s{chance.randrange(2)}", i, day + datetime.timedelta(days=i // 2), chance.choice(["added", "added", "removed"]), chance.randrange(6)) for i in range(200)]
    df = spark.createDataFrame(events, "segment string, seq long, date date, kind string, member long")
    dates = [day + datetime.timedelta(days=d) for d in (0, 1, 30, 31, 59, 99, 400)]
    got = temporal.replayed_at(temporal.validity(df), spark.createDataFrame([(d,) for d in dates], "date date"))
    want = [(d, r.segment, r.member, r.since) for d in dates for r in temporal.replayed(df, d.isoformat()).collect()]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("threshold", [0.1, 0.5, 1.0])
def test_baskets_equal_all_pairs(spark, threshold):
    chance = random.Random(9)
    rows = {(b, i) for b in range(150) for i in chance.sample(range(25), chance.randrange(1, 6))} | {(b, 100) for b in range(150)} | {(b, 101) for b in range(140)}
    rows |= {(b, 200 + k) for b, i in rows if i == 3 for k in range(2)}  # copies of product 3
    df = spark.createDataFrame([*rows, *list(rows)[:50], (None, 1), (1, None)], "basket long, item long")
    sets = {}
    for b, i in rows:
        sets.setdefault(i, set()).add(b)
    members = {r.item: r.representative for r in baskets.classes(df).collect()}
    assert members == {i: min(j for j in sets if sets[j] == sets[i]) for i in sets} and members[201] == 3
    want = {(a, b, len(sets[a] & sets[b])) for a, b in combinations(sorted({*members.values()}), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
    assert {(r.a, r.b, r.together) for r in baskets.alike(df, threshold).collect()} == want
    assert baskets.alike(df.limit(0), threshold).count() == 0
    assert baskets.alike(df.withColumn("extra", F.lit(1)), threshold).columns == ["a", "b", "together", "n_a", "n_b", "similarity"]


def test_pairs_that_cannot_reach_the_threshold_are_not_counted_in_full(spark, monkeypatch):
    """At a low threshold nearly every pair shares a basket of both prefixes; how many they share there rules out most."""
    held, plain = {}, baskets.written

    def spy(df, tag):
        out = plain(df, tag)
        held[tag] = out.count()
        return out

    monkeypatch.setattr(baskets, "written", spy)
    chance = random.Random(8)
    rows = {(chance.randrange(1_500), item) for item in range(200) for _ in range(30)}
    of = {i: {b for b, x in rows if x == i} for i in range(200)}
    want = {(a, b) for a in of for b in of if a < b and len(of[a] & of[b]) >= 0.04 * len(of[a] | of[b])}
    got = baskets.alike(spark.createDataFrame(sorted(rows), "basket long, item long"), 0.04)
    assert {(r.a, r.b) for r in got.collect()} == want
    assert len(want) <= held["pairs"] < sum(1 for a in of for b in of if a < b and of[a] & of[b]) / 4
