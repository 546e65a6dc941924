import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tessella.llm import spelling
from tests.conftest import SMALL


def plain(rows):
    """Counts by the rule, near words by a table of all words with one code point left out."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    masks = defaultdict(set)
    near = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            masks[w[:i], w[i + 1 :]].add(w)
            if (less := w[:i] + w[i + 1 :]) in counts:
                near[w].add(less)
                near[less].add(w)
    for group in masks.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in counts:
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= 5 * counts[w]:
                form[w] = best
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        yield w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None


def got(frame):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect())


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = sorted(plain(rows), key=lambda r: r[0])
    assert len(want) > 100 and any(r[1] for r in want)
    assert got(spelling.query(spark, SMALL)) == want


def made(seed, n):
    chance = random.Random(seed)
    base = ["".join(chance.choice("abé") for _ in range(chance.randrange(5, 9))) for _ in range(40)]
    return [(i, " ".join(chance.choice(base) + chance.choice(["", "", "a", "é", "z"]) for _ in range(chance.randrange(60)))) for i in range(n)]


@pytest.mark.parametrize("most", [2, 1_000])
def test_dense_words_whole_and_in_pieces(spark, most, monkeypatch):
    monkeypatch.setattr(spelling, "BATCH", 7)
    rows = made(3, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(plain(rows), key=lambda r: r[0])
    assert sum(r[4] for r in want) > 100
    assert got(spelling.variants(docs, most)) == want


def test_paths_of_forms(spark):
    chain = [("kettles", 5), ("kettled", 25), ("kettlee", 125), ("kottlee", 700), ("xottlee", 3500)]
    rows = [(1, " ".join(" ".join([w] * n) for w, n in chain))]
    found = {r[0]: r for r in got(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert {r[2] for r in found.values()} == {"xottlee"} and found["kettles"][1] == "kettlee"


def test_odd_rows(spark):
    long = "a" * 20_000
    rows = [(None, None), (None, ""), (None, "straße STRASSE"), (2, f"{long} {long}b " * 6), (2, f"{long} {long}b " * 6), (3, "ABCÉFG abcÉfg " * 9), (3, "ÀÿÖ×÷ß " * 7), (4, "ÀÿÖ×÷ß " * 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS key")
    assert got(spelling.variants(docs)) == sorted(plain(rows), key=lambda r: r[0])
    assert got(spelling.variants(docs.limit(0))) == []


def test_automaton_numbers_words():
    chance = random.Random(1)
    words = sorted({"".join(chance.choice("abc") for _ in range(chance.randrange(1, 8))) for _ in range(500)})
    automaton = spelling.Automaton(words)
    for number, word in enumerate(words):
        state, found = automaton.walk(automaton.start, 0, word)
        assert automaton.final[state] and found == number
    assert len(automaton.arcs) < sum(map(len, words)) / 3
    assert automaton.walk(automaton.start, 0, "abcd")[0] == -1
