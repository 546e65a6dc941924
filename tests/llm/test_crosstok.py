import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import crosstok
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def made():
    a, b = crosstok.vocabulary_paths()
    tokenizer = Tokenizer.from_file(a)
    tokenizer.encode_special_tokens = True
    letters = crosstok._byte_letters()
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=b), letters


def plain_groups(made, text):
    """Groups by sets of common ends, over the whole text at once."""
    tokenizer, pieces, letters = made
    if not text:
        return []
    want = (" " + text).encode()
    ids_a, ids_b = tokenizer.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    bytes_a = [bytes(letters[c] for c in tokenizer.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return []

    def ends(parts):
        at, out = 0, []
        for p in parts:
            at += len(p)
            out.append(at)
        return out

    ends_a, ends_b = ends(bytes_a), ends(bytes_b)
    common, found, i, j = sorted(set(ends_a) & set(ends_b)), [], 0, 0
    for end in common:
        a, b = [], []
        while i < len(ids_a) and ends_a[i] <= end:
            a.append(ids_a[i])
            i += 1
        while j < len(ids_b) and ends_b[j] <= end:
            b.append(ids_b[j])
            j += 1
        found.append((a, b))
    return found


def plain(made, rows):
    per = [(doc, plain_groups(made, text)) for doc, text in rows]
    counts = Counter(pair for _, groups in per for pair in {(x, y) for a, b in groups for x in a for y in b})
    top = {}
    for (x, _), n in counts.items():
        top[x] = max(top.get(x, 0), n)
    for doc, groups in per:
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield doc, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""


def got(frame):
    return [tuple(r) for r in frame.collect()]


def test_query_equals_brute_force(spark, made):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted(got(crosstok.query(spark, SMALL))) == sorted(plain(made, rows))


ODD = [None, "", " ", "\n", " a", "a ", "a  b", "a\n\nb", "\nx", "x\n", "a \n b", "a\tb c", "▁", "x ▁y", "<|endoftext|> <s> <0x41>", "\x00 \x1c \x85 z", "　​ ﻿ x᠎ y", "don't 'll 's", "中文字 \U0001f600\U0001f600 x", "=" * 3000, "\U0001f600" * 400, "ab" * 4000, "é ﬁ é", "123456 7.5 1,000"]


def test_odd_texts(spark, made):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "x y"), (3, "x y"), (3, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS n_a", "'k' AS keys", "1 AS chunk")
    assert sorted(got(crosstok.aligned(docs)), key=repr) == sorted(plain(made, rows), key=repr)
    assert got(crosstok.aligned(docs.limit(0))) == []


def test_random_texts_and_a_small_memory(made, monkeypatch):
    chance = random.Random(5)
    parts = ["a", "Bc", "'ll", " ", " ", " ", "\n", "7", "--", "é", "中", "word", ".", "\t", " ", "\U0001f600", "  ", " ", "="]
    texts = ["".join(chance.choice(parts) for _ in range(chance.randrange(40))) for _ in range(2000)]
    monkeypatch.setattr(crosstok, "MEMORY_PIECES", 100)
    aligner = crosstok.Aligner(*crosstok.vocabulary_paths())
    for at in range(0, len(texts), 50):
        found = aligner.chunk(texts[at : at + 50])
        for text, figures, digest in zip(texts[at : at + 50], found["figures"], found["digests"], strict=True):
            groups = plain_groups(made, text)
            assert figures[2] == len(groups), repr(text)
            written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
            assert digest == (hashlib.sha256(written.encode()).hexdigest() if groups else ""), repr(text)


def test_large_groups_are_counted_by_id(made, monkeypatch):
    monkeypatch.setattr(crosstok, "LAID_OUT", 1)
    few = crosstok.Aligner(*crosstok.vocabulary_paths()).chunk(ODD)
    monkeypatch.setattr(crosstok, "LAID_OUT", 1 << 30)
    all_ = crosstok.Aligner(*crosstok.vocabulary_paths()).chunk(ODD)
    assert all((few[k] == all_[k]).all() for k in ("figures", "keys", "held", "at", "links", "upto"))


def test_groups_have_ids_and_spans(spark, made):
    texts = ["Hello there, friend", "naïve 中", None, "x ▁y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in crosstok.groups(docs).orderBy("doc_id").collect():
        want = plain_groups(made, texts[row.doc_id])
        assert [(g.a, g.b) for g in row.groups] == want
        if want:
            assert row.groups[0].start == 0 and row.groups[-1].end == len((" " + texts[row.doc_id]).encode())
            assert all(x.end == y.start for x, y in zip(row.groups, row.groups[1:]))
    assert crosstok.groups(docs).where(F.size("groups") == 0).count() == 2


def test_chunks_are_held_few_at_a_time(spark, made, monkeypatch):
    """However many chunks a task has: few in a file, and one at a time where counts come back."""
    monkeypatch.setattr(crosstok, "CHUNK_ROWS", 3)
    rows = [(i, f"word{i % 5} and {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    files = crosstok.chunked(docs).groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) == 20 and max(r["count"] for r in files) <= 4
    frame = crosstok.aligned(docs)
    assert sorted(got(frame)) == sorted(plain(made, rows))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "MapInArrow" not in plan
