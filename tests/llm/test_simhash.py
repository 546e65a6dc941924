import numpy as np
import xxhash

from tessella.llm import simhash
from tests.conftest import SMALL


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = {i: brute_fingerprint(t) for i, t in rows}
    ids, root = sorted(fps), {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, SMALL).collect()}
    assert got == want


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, "\t \n"), (7, "One two"), (7, "One two"), (None, "one TWO"), (None, "ein zwei drei vier"), (8, "Äpfel " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(simhash.near_duplicates(docs).collect(), key=repr)
    assert len(got) == len(rows)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert [c for (i, f), c in by.items() if f == "0" * 16] == [3, 3, 3]
    assert by[7, f"{brute_fingerprint('one two'):016x}"] == 7 == by[None, f"{brute_fingerprint('one two'):016x}"]
    assert by[None, f"{brute_fingerprint('ein zwei drei vier'):016x}"] is None
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_keeps_one_of_each_component_and_all_columns(spark):
    rows = [(2, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "z"), (4, None, None), (3, "", "q"), (None, "u v w x y", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hash string").selectExpr("*", "'mine' AS `a.b`", "7 AS _row")
    got = simhash.keep_one(docs).collect()
    assert simhash.keep_one(docs).columns == docs.columns
    assert {r._hash for r in got} <= {"y", "z", "q", "n"} and {r["a.b"] for r in got} == {"mine"} and {r._row for r in got} == {7}
    assert sorted((str(r.doc_id), r.text) for r in got) == [("1", "a b c d"), ("3", ""), ("None", "u v w x y")]


def test_keep_one_of_many_equal_rows(spark):
    many = [(None, "a b c d e", n % 3, {"k": n}) for n in range(4000)] + [(5, "other words stand in here", 0, None)] * 3
    docs = spark.createDataFrame(many, "doc_id long, text string, n long, m map<string,long>").repartition(16)
    got = sorted((str(r.doc_id), r.text) for r in simhash.keep_one(docs).collect())
    assert got == [("5", "other words stand in here"), ("None", "a b c d e")]
    assert {r.n for _ in range(2) for r in simhash.keep_one(docs.repartition(5)).where("doc_id IS NULL").collect()} == {r.n for r in simhash.keep_one(docs).where("doc_id IS NULL").collect()}


def test_large_nodes_are_cut_without_losing_links(spark):
    rng = np.random.default_rng(1)
    near = np.full(300, rng.integers(0, 2**63), np.uint64)
    for _ in range(5):
        near ^= np.uint64(1) << rng.integers(0, 64, 300, np.uint64)
    x = np.unique(np.concatenate([near, rng.integers(0, 2**63, 200, np.uint64)]))
    fps = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    roots = lambda most: len({r.root for r in simhash.connected_components(simhash.edges(fps, node_most=most)).collect()})
    linked = simhash.linked(x)
    want = len({v for v, n in zip(*np.unique(linked, return_counts=True), strict=True) if n > 1})
    assert roots(40) == roots(10**6) == want


def test_index_agrees_with_all_pairs():
    rng = np.random.default_rng(2)
    for _ in range(5):
        base = rng.integers(0, 2**63, 60, np.uint64)
        parts = [base]
        for flips in range(1, 7):
            y = base.copy()
            for _ in range(flips):
                y ^= np.uint64(1) << rng.integers(0, 64, len(base), np.uint64)
            parts.append(y)
        x = np.unique(np.concatenate(parts))
        rng.shuffle(x)
        a, b = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4, 1))
        assert (simhash.linked(x) == simhash._merge(np.arange(len(x)), a, b)).all()
