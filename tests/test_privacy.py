import math
import random
from concurrent.futures import ThreadPoolExecutor

import pytest

from tessella.operators import ledger, privacy


def test_what_is_spent_survives_and_no_two_take_the_last_share(spark, tmp_path):
    folder = f"file://{tmp_path}/ledger"
    assert ledger.Ledger(spark, folder, 1.0).reserve(ledger.pure("a", 0.4))
    with ThreadPoolExecutor(8) as pool:  # six askers for two shares
        granted = list(pool.map(lambda i: ledger.Ledger(spark, folder, 1.0).reserve(ledger.pure(str(i), 0.3)), range(6)))
    again = ledger.Ledger(spark, folder, 1.0)
    assert sum(granted) == 2 and len(again.entries()) == 3 and abs(again.spent - 1.0) < 1e-12
    assert not again.reserve(ledger.pure("b", 0.01))


def test_divergences_add_up_more_slowly_than_epsilons():
    many = [ledger.pure("q", 0.01)] * 1000
    assert ledger.spent(many, 1e-6) < 2.0 < sum(e.epsilon for e in many)
    one = ledger.gaussian("g", 4.0)
    assert ledger.spent([one], 1e-6) == min(a / 32 + math.log(1e6) / (a - 1) for a in ledger.ORDERS)
    assert ledger.spent([], 1e-6) == 0.0


def plain(rows, k):
    """Groups by recursive median cuts."""
    span = [max(r[1][i] for r in rows) - min(r[1][i] for r in rows) or 1.0 for i in range(2)]

    def cut(group):
        order = sorted(range(2), key=lambda i: (-(max(r[1][i] for r in group) - min(r[1][i] for r in group)) / span[i], i))
        for i in order:
            middle = sorted(r[1][i] for r in group)[len(group) // 2]
            low = [r for r in group if r[1][i] < middle]
            if len(low) >= k and len(group) - len(low) >= k:
                return cut(low) + cut([r for r in group if r[1][i] >= middle])
        return [frozenset(r[0] for r in group)]

    return set(cut(rows))


@pytest.mark.parametrize("k", [1, 3, 10])
def test_median_cuts_equal_plain_ones(spark, k):
    chance = random.Random(k)
    rows = [(i, [float(chance.randrange(40)), chance.choice([0.0, 0.0, 1.0, 50.5, chance.random()])]) for i in range(120)]
    df = spark.createDataFrame([(i, *x) for i, x in rows], "id long, a double, b double").selectExpr("*", "1 AS _x", "2 AS n")
    found, ends = {}, {}
    for r in privacy.median_cuts(df, ["a", "b"], k).collect():
        found.setdefault(r._group, set()).add(r.id)
        ends[r._group] = (r.a_low, r.a_high, r.b_low, r.b_high)
        assert r.a_low <= r.a <= r.a_high and r.b_low <= r.b <= r.b_high
    assert {frozenset(g) for g in found.values()} == plain(rows, k)


def test_cuts_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, 1.0), (2, 5.0, float("nan")), (3, 6.0, 2.0), (4, 6.0, 2.0)], "id long, a double, b double")
    assert privacy.median_cuts(rows, ["a", "b"], 5).count() == 0
    assert sorted(r.id for r in privacy.median_cuts(rows, ["a", "b"], 2).collect()) == [1, 2, 3, 4]
    assert privacy.median_cuts(rows.limit(0), ["a"], 1).count() == 0
    with pytest.raises(ValueError):
        privacy.median_cuts(rows, [], 2)
