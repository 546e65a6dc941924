import zlib
from collections import Counter, defaultdict

from tessella.llm import sharding
from tests.conftest import SMALL


def check(rows, texts):
    """The law of even counts, gapless slots, and sizes and checksums of the texts."""
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts)
    counts = Counter(r.shard for r in rows)
    even = [counts[s] for s in range(sharding.SHARDS)]
    assert max(even) - min(even) <= 1 and set(counts) <= set(range(sharding.SHARDS))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want


def test_query_keeps_equal_texts_together(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sharding.query(spark, SMALL).collect()
    check(got, docs)
    text = dict(docs)
    shards = defaultdict(set)
    for r in got:
        shards[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_a_group_larger_than_a_shard_is_cut_as_little_as_it_can_be(spark):
    rows = [(i, "hot") for i in range(120)] + [(200 + i, f"pair {i // 2}") for i in range(80)] + [(400 + i, f"own {i}") for i in range(40)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(got, rows)
    shards = defaultdict(set)
    text = dict(rows)
    for r in got:
        shards[text[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for t, s in shards.items() if t.startswith("pair")) <= 8


def test_where_rows_go_does_not_depend_on_how_they_are_dealt(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    a = {(r.doc_id, r.shard, r.slot) for r in sharding.sharded(docs).collect()}
    b = {(r.doc_id, r.shard, r.slot) for r in sharding.sharded(docs.repartition(7)).collect()}
    assert a == b


def test_odd_rows(spark):
    rows = [(1, None), (2, None), (3, ""), (3, ""), (None, "x"), (5, "long " * 50_000), (6, "ä"), (7, "same"), (8, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS slot", "3 AS key")
    check(sharding.sharded(docs).collect(), rows)
    assert sharding.sharded(docs.limit(0)).count() == 0
    alike = [(i, "all alike") for i in range(21)]
    check(sharding.sharded(spark.createDataFrame(alike, "doc_id long, text string")).collect(), alike)
