import random
import re
import time

import numpy as np
import pytest

from tessella.llm import decontam
from tests.conftest import SMALL


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def align(a, b):
    """Plain Smith-Waterman."""
    best, last = 0.0, [0.0] * (len(b) + 1)
    for x in a:
        row = [0.0]
        for j, y in enumerate(b):
            row.append(max(0.0, last[j] + (decontam.MATCH if x == y else decontam.MISMATCH), last[j + 1] + decontam.GAP, row[j] + decontam.GAP))
        best, last = max(best, *row), row
    return best


def brute(docs, items):
    found = {}
    for i, text in docs:
        for k, item in items:
            own = words(item)
            if len(own) >= decontam.SEED_WORDS and (score := align(own, words(text))) >= decontam.needed(len(own)):
                found[i, k] = round(score / len(own), 4)
    return found


def test_query_equals_full_alignment(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    some = [d for d in docs if len(words(d[1])) < 400]
    got = {(r.doc_id, r.item_id): r.score for r in decontam.query(spark, SMALL).collect()}
    kept = {i for i, _ in some}
    assert {k: v for k, v in got.items() if k[0] in kept} == brute(some, items)


def test_edited_copies_are_found_and_clean_texts_are_not(spark):
    chance = random.Random(1)
    vocabulary = ["".join(chance.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    text = lambda n: [chance.choice(vocabulary) for _ in range(n)]
    items = [(k, text(40)) for k in range(12)]
    docs = []
    for k, item in items:
        edited = [w if n % 6 else chance.choice(vocabulary) for n, w in enumerate(item)]
        docs.append((k, " ".join([*text(100), *edited[:20], "inserted", *edited[20:], *text(100)])))
        docs.append((100 + k, " ".join(text(300))))
    # One item is in a third of all documents: its seeds stay seeds.
    docs += [(1000 + n, "! ".join([*text(20), *items[0][1], *text(20)]).upper()) for n in range(12)]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in range(12)} | {(1000 + n, 0) for n in range(12)}


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "alpha beta gamma delta"), (4, "alpha beta gamma delta"), (None, "eins zwei drei vier fünf")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "x ALPHA, beta—gamma «delta» y", 7), (None, "eins zwei drei vier fünf", 7), (5, "alpha beta gamma", 7), (6, "w " * 50_000, 7)], "doc_id long, text string, item_id int")
    got = sorted(((r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()), key=repr)
    assert got == [(3, 4), (3, 4), (None, None)]
    clean = decontam.keep_clean(docs, items)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [1, 2, 5, 6]
    assert decontam.contaminated(docs.limit(0), items).count() == 0
    assert decontam.contaminated(docs, items.limit(0)).count() == 0


def test_alignment_by_diagonals_is_alignment():
    chance = random.Random(2)
    for _ in range(40):
        a, b = ([chance.randrange(6) for _ in range(chance.randrange(1, 30))] for _ in range(2))
        assert decontam.align(np.array(a, np.uint64), np.array(b, np.uint64)) == align(a, b)


@pytest.mark.parametrize("copies", [3, 1000])
@pytest.mark.parametrize("kind", ["edited", "half", "three quarters", "whole and edited"])
def test_repeated_partial_leaks_are_found_in_every_document(spark, kind, copies):
    chance = random.Random(3)
    vocabulary = ["".join(chance.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    text = lambda n: [chance.choice(vocabulary) for _ in range(n)]
    item = text(40)
    edited = [f"new{n}" if n in (3, 13, 23, 33) else w for n, w in enumerate(item)]
    passage = {"edited": edited, "half": item[:24], "three quarters": item[:30], "whole and edited": edited}[kind]
    docs = [(k, " ".join([*text(15), *passage, *text(15)])) for k in range(copies)]
    docs += [(copies, " ".join([*text(15), *item, *text(15)]))] if kind == "whole and edited" else []
    docs += [(10_000 + k, " ".join([*text(30), *item[9 * k : 9 * k + 9], *text(30)])) for k in range(4)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontam.contaminated(frame, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.score for r in got} == brute(docs, [(7, " ".join(item))])
    assert {r.doc_id for r in got} >= set(range(copies))


def test_no_alignment_scores_above_its_ceiling():
    chance = random.Random(4)
    for _ in range(60):
        a, b = ([chance.choice("pqrstuvwxyz") for _ in range(chance.randrange(3, 30))] for _ in range(2))
        items, words = decontam.Items.made([1, 2], ["other words here", " ".join(a)], 3), decontam.Words(["before", " ".join(b)])
        top = decontam.ceilings(items, words, np.array([1, 0]), np.array([1, 1]), np.array([1 + len(b)] * 2))
        assert max(0.0, top[0]) >= align(a, b) and top[1] <= 0  # a stretch has one word at least, which may be a penalty


def test_alignment_of_long_sequences_takes_little_memory():
    import tracemalloc

    chance = np.random.default_rng(5)
    item = chance.integers(0, 1 << 60, 20_000).astype(np.uint64)
    passage = np.concatenate([item[:4_000], chance.integers(0, 1 << 60, 100).astype(np.uint64), item[4_000:5_000]])
    tracemalloc.start()
    score = decontam.align(item, passage)
    assert tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()
    assert score == 5_000 - 50


def test_alignments_in_batches_equal_plain_ones():
    chance = random.Random(7)
    pairs = [([chance.randrange(6) for _ in range(chance.randrange(30))], [chance.randrange(6) for _ in range(chance.randrange(60))]) for _ in range(400)]
    got = decontam.align_all([(np.array(a, np.uint64), np.array(b, np.uint64)) for a, b in pairs])
    assert got.tolist() == [align(a, b) for a, b in pairs]


def templated(chance, n):
    vocabulary = ["".join(chance.choice("abcdefghij") for _ in range(6)) for _ in range(20_000)]
    head = "which of the following is number".split()
    items = [[*head, *[chance.choice(vocabulary) for _ in range(14)]] for _ in range(n)]
    return head, items, vocabulary


def test_a_phrase_that_many_items_share_costs_little_and_hides_nothing(monkeypatch):
    chance = random.Random(2)
    head, items, vocabulary = templated(chance, 60_000)
    made = decontam.Items.made(list(range(len(items))), [" ".join(i) for i in items], decontam.SEED_WORDS)
    dense = " ".join(w for _ in range(60) for w in [*head, chance.choice(vocabulary)])
    leak = [w if n % 4 else chance.choice(vocabulary) for n, w in enumerate(items[777])]
    began = time.process_time()
    assert list(decontam.matches(made, [dense] * 3, decontam.SEED_WORDS)) == []
    assert {k for _, k, _ in decontam.matches(made, [dense + " " + " ".join(leak) + " " + dense], decontam.SEED_WORDS)} == {777}
    assert time.process_time() - began < 10


def test_segments_find_what_whole_documents_do(monkeypatch):
    chance = random.Random(4)
    head, items, vocabulary = templated(chance, 50)
    made = decontam.Items.made(list(range(50)), [" ".join(i) for i in items], decontam.SEED_WORDS)
    texts = []
    for k in range(30):
        body = [chance.choice(vocabulary) for _ in range(chance.randrange(1500))] + head * chance.randrange(5)
        for i in chance.sample(range(50), 3):
            at = chance.randrange(len(body) + 1)
            body[at:at] = [w if chance.random() > 0.2 else "x" for w in items[i]]
        texts.append(" ".join(body))
    want = sorted(decontam.matches(made, texts, decontam.SEED_WORDS))
    monkeypatch.setattr(decontam, "PIECE", 20)
    monkeypatch.setattr(decontam, "SEGMENT", 64)
    assert sorted(decontam.matches(made, texts, decontam.SEED_WORDS)) == want and len(want) > 40


@pytest.mark.parametrize(("every", "least"), [(3, 0.99), (4, 0.99), (5, 0.99)])
def test_recall_of_copies_with_every_nth_word_changed(every, least):
    chance = random.Random(every)
    _, items, vocabulary = templated(chance, 200)
    made = decontam.Items.made(list(range(200)), [" ".join(i) for i in items], decontam.SEED_WORDS)
    texts = [" ".join([*[chance.choice(vocabulary) for _ in range(50)], *[w if n % every != every - 1 else chance.choice(vocabulary) for n, w in enumerate(i)], *[chance.choice(vocabulary) for _ in range(50)]]) for i in items]
    found = {(d, k) for d, k, _ in decontam.matches(made, texts, decontam.SEED_WORDS)}
    assert len(found & {(k, k) for k in range(200)}) / 200 >= least
