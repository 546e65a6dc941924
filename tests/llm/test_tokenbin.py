import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessella.llm import tokenbin
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def plain():
    made = Tokenizer.from_file(tokenbin.tokenizer_path())
    return lambda text: [*made.encode(text or "", add_special_tokens=False).ids, 0]


def want(rows, plain):
    start = 0
    for doc, text in rows:
        ids = plain(text)
        yield doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_query_equals_plain_encoding(spark, plain):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    got = tokenbin.query(spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == list(want([(r.doc_id, r.text) for r in docs], plain))


def test_odd_rows(spark, plain):
    rows = [(1, None), (2, ""), (3, " a  b\n c \t"), (4, "!" * 5000), (5, "<|endoftext|> don't"), (5, "<|endoftext|> don't"), (7, "wort " * 9000 + "ß  x　 y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS shard", "1 AS start")
    got = tokenbin.encoded(docs).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    assert [tuple(r) for r in got] == list(want(rows, plain))
    assert tokenbin.encoded(docs.limit(0)).count() == 0


def test_pieces_encode_as_whole_texts(plain):
    chance = random.Random(3)
    encode = tokenbin.encoder(tokenbin.tokenizer_path())
    texts = ["".join(chance.choice(["a", "B'll", " ", " ", "\n", "7", "-", "é", " ", "'s", "中", "word", ".", "\t"]) for _ in range(chance.randrange(40))) for _ in range(3000)]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "x\x01 y, z.", "a.\nb!\nc", "", "end."]
    ids, sizes = encode(texts)
    at = np.cumsum(sizes)
    for text, end, n in zip(texts, at, sizes, strict=True):
        assert ids[end - n : end].tolist() == plain(text)[:-1], repr(text)
    ids, sizes = encode(texts, 0)
    assert ids.tolist() == [i for t in texts for i in plain(t)] and sizes.tolist() == [len(plain(t)) for t in texts]


def test_memory_is_bounded_in_bytes(plain, monkeypatch):
    monkeypatch.setattr(tokenbin, "MEMORY_BYTES", 4_000)
    encode = tokenbin.Encoder(tokenbin.tokenizer_path())
    for k in range(30):
        texts = [" ".join(f"w{k}x{i}," for i in range(100))]
        assert encode(texts)[0].tolist() == plain(texts[0])[:-1]
        assert encode.keys.nbytes + encode.ids.nbytes < 4_000 + 5_000


def test_null_and_repeated_ids(spark, plain):
    rows = [(None, "one two"), (None, "three"), (4, "b"), (4, "a"), (4, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7L AS n_tokens", "'s' AS _text")
    got = tokenbin.encoded(docs).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 4, 4, 4]
    assert sorted((r.doc_id is None, r.ids_crc32) for r in got) == sorted((d is None, zlib.crc32(np.array(plain(t), "<u4").tobytes())) for d, t in rows)


def test_sequences_have_equal_length_and_masks(tmp_path):
    made = tokenbin.ShardWriter(f"file://{tmp_path}", 0, np.dtype("<u2"), 16)
    stream = np.arange(16 * tokenbin.BATCH * 2 + 21, dtype="<u2")
    made.add(stream, np.array([1000, len(stream) - 1000]), pa.array([4, 9]))
    made.close()
    reader = tokenbin.ShardReader(f"file://{tmp_path}", 0)
    assert (reader.span(0, len(stream)) == stream).all()
    ids, mask = reader.sequence(3)
    assert ids.tolist() == list(range(48, 64)) and mask.all()
    last = -(-len(stream) // 16) - 1
    ids, mask = reader.sequence(last)
    assert mask.sum() == len(stream) - last * 16
    assert reader.index.read_all().to_pydict() == {"doc_id": [4, 9], "start": [0, 1000], "n_tokens": [1000, len(stream) - 1000]}


def test_shards_are_cut_by_bytes_and_the_index_by_documents(spark, plain, monkeypatch):
    monkeypatch.setattr(tokenbin, "SHARD_BYTES", 500)
    rows = [(i, f"text {i} of " + "some words " * (i % 9)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = tokenbin.encoded(docs).orderBy("doc_id").collect()
    assert [tuple(r)[:4] for r in got] == list(want(rows, plain))
    assert len({r.shard for r in got}) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_index_is_written_in_batches(tmp_path, monkeypatch):
    monkeypatch.setattr(tokenbin, "INDEX_BATCH", 10)
    out = tokenbin.ShardWriter(tmp_path.as_uri(), 0, np.dtype(np.uint16), 8)
    for k in range(7):
        sizes = np.arange(k, k + 4)
        out.add(np.full(sizes.sum(), k, np.uint16), sizes, pa.array(range(4 * k, 4 * k + 4)))
    assert out.listed == 4
    out.close()
    reader = tokenbin.ShardReader(tmp_path.as_uri(), 0)
    index = reader.index.read_all()
    sizes = np.concatenate([np.arange(k, k + 4) for k in range(7)])
    assert index["doc_id"].to_pylist() == list(range(28))
    assert index["start"].to_pylist() == (np.cumsum(sizes) - sizes).tolist() and index["n_tokens"].to_pylist() == sizes.tolist()
    assert reader.index.num_record_batches == 3
