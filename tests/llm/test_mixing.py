from collections import Counter, defaultdict

from tessella.llm import mixing
from tests.conftest import SMALL


def water(sizes):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def check(rows):
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r["size"]
    assert all(r.source_size == sizes[r.source] for r in rows)
    want = water(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - round(want[s])) <= 1


def test_query_meets_the_targets_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = mixing.query(spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs)
    check(got)
    again = mixing.mixed(mixing.sized(spark.read.parquet(f"{SMALL}/documents.parquet").repartition(7))).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (4, "w " * 5000, "b"), (4, "w " * 5000, "b"), (None, "p q r", "b"), (7, "  \t", "c"), (8, "one", "\U0001f600"), (9, "two three", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS block", "2 AS start")
    got = mixing.mixed(mixing.sized(docs)).collect()
    assert len(got) == len(rows)
    check(got)
    assert mixing.mixed(mixing.sized(docs.limit(0))).count() == 0
    copies = mixing.repeated(docs)
    assert copies.columns == docs.columns
    assert {r.doc_id for r in copies.collect()} >= {1, 2, 7}


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        df = spark.range(n).select(F.col("id"), mixing.permuted(F.col("id"), F.lit(n), F.lit("s")).alias("p"))
        df = df.withColumn("back", mixing.permuted(F.col("p"), F.lit(n), F.lit("s"), inverse=True))
        rows = df.collect()
        assert sorted(r.p for r in rows) == list(range(n))
        assert all(r.back == r.id for r in rows)


def test_blocks_hold_the_words_that_are_counted(spark):
    docs = spark.createDataFrame([(i, " ".join(f"d{i}w{k}" for k in range(10 + 37 * i)), "ab"[i % 2]) for i in range(12)], "doc_id long, text string, source string")
    made = defaultdict(int)
    for r in mixing.blocks(docs, block=16).collect():
        assert len(r.words) <= 16
        for w in r.words:
            made[int(w[1 : w.index("w")])] += 1
    want = {r.doc_id: r.taken for r in mixing.mixed(mixing.sized(docs), block=16).collect()}
    assert {d: made[d] for d in want} == want


def test_shards_take_the_slots_that_they_drew(spark):
    sources = spark.createDataFrame([("a", 4_000, 6_000.0), ("b", 9_000, 9_500.0), (None, 100, 200.0)], "source string, source_size long, target double")
    got = mixing.slots(sources, block=16, shard_slots=64).collect()
    shards, of = defaultdict(Counter), defaultdict(list)
    for r in got:
        shards[r.shard][r.source] += 1
        of[r.source].append(r)
    assert len(shards) == -(-len(got) // 64)
    for source, rows in of.items():
        rows.sort(key=lambda r: r.slot)
        assert [r.slot for r in rows] == list(range(len(rows)))
        assert [r.shard for r in rows] == sorted(r.shard for r in rows)
        goal = {"a": 6_000, "b": 9_500, None: 200}[source]
        assert sum(r.take for r in rows) == goal
        n = max(r.block for r in rows) + 1
        assert sorted(r.block for r in rows[:n]) == list(range(n))  # a pass takes every block once
        # The counts of the shards scatter as those of independent trials do.
        if source is not None:
            mean = len(rows) / len(shards)
            chi = sum((c[source] - mean) ** 2 / mean for c in shards.values())
            assert 0.1 * len(shards) < chi < 2.5 * len(shards)


def test_rows_without_ids_are_drawn_one_by_one(spark):
    docs = spark.range(4_000).selectExpr("CAST(NULL AS long) AS doc_id", "'one two three four' AS text", "IF(id < 3000, 'a', 'b') AS source", "id AS own")
    want = {r.source: r.target / r.source_size for r in mixing.targets(spark.createDataFrame([("a", 12_000), ("b", 4_000)], "source string, source_size long")).collect()}
    got = Counter(r.source for r in mixing.repeated(docs).collect())
    assert abs(got["a"] / 3_000 - want["a"]) < 0.1 and abs(got["b"] / 1_000 - want["b"]) < 0.1


def test_another_draw_changes_the_shards_and_not_the_totals(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (5 + i % 40)), "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    made = [{r.doc_id: (r.taken, (r.first_shard, r.last_shard)) for r in mixing.mixed(mixing.sized(docs), 16, 32, seed).collect()} for seed in (1, 1, 2)]
    assert made[0] == made[1]
    assert {d: t for d, (t, _) in made[0].items()} == {d: t for d, (t, _) in made[2].items()}
    assert sum(made[0][d][1] != made[2][d][1] for d in made[0]) > 50


def test_shards_are_those_that_hold_the_words(spark):
    docs = spark.createDataFrame([(i, " ".join(f"d{i}w{k}" for k in range(3 + 17 * i)), "ab"[i % 2]) for i in range(12)], "doc_id long, text string, source string")
    held = defaultdict(set)
    for r in mixing.blocks(docs, block=16, shard_slots=8).collect():
        for w in r.words:
            held[int(w[1 : w.index("w")])].add(r.shard)
    got = {r.doc_id: (r.first_shard, r.last_shard) for r in mixing.mixed(mixing.sized(docs), 16, 8).collect()}
    assert got == {d: (min(held[d]), max(held[d])) if held[d] else (None, None) for d in got} and len(set(got.values())) > 4
