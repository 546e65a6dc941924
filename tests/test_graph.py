import random

import pytest

from tessella.operators.graph import connected_components


def _numbers(kind: str, n: int) -> list[int]:
    at = list(range(n))
    if kind == "shuffled":
        random.Random(5).shuffle(at)
    return at


@pytest.mark.parametrize("kind", ["sorted", "shuffled"])
def test_long_chains_settle_in_few_rounds(spark, kind):
    at = _numbers(kind, 10_000)
    edges = spark.createDataFrame(list(zip(at, at[1:], strict=False)), "a long, b long")
    got = connected_components(edges, most_rounds=20).collect()
    assert {r.root for r in got} == {0} and len(got) == 10_000


def test_components_equal_search(spark):
    chance = random.Random(2)
    pairs = [(chance.randrange(400), chance.randrange(400)) for _ in range(260)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for x in range(400)}
    for _ in range(400):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: root[x] for x in {x for a, b in pairs if a != b for x in (a, b)}}


def test_no_edges_loops_and_nulls(spark):
    assert connected_components(spark.createDataFrame([(3, 3), (None, 2), (4, None)], "a long, b long")).count() == 0
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
