"""Token ids in Arrow files of equal-length sequences.

A corpus is one stream of ids: each document's ids, then an end id, in
ascending document order. Shard files hold consecutive stretches of it, each
cut into sequences of ``length`` ids; the last sequence of a shard is padded.
A shard is an Arrow file (stream with a footer) whose batches have two
fixed-size-list columns without nulls, ``ids`` (uint16, or uint32 for large
vocabularies) and ``mask`` (bits: true where an id is real). Mapped into
memory, sequence i of a batch is a slice of its one buffer, so any sequence is
reached without reading or copying the others. Beside each shard stands an
index of its documents (doc, start, n_tokens), also an Arrow file.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import slices
from tessella.sources.scratch import fresh
from tessella.sources.tables import table

END = 0
LENGTH = 2_048
#: Sequences of a record batch.
BATCH = 512
#: Documents after which a batch of the index is written.
INDEX_BATCH = 65_536
#: Bytes of text that go into a shard.
SHARD_BYTES = 1 << 30
#: Bytes of pieces and their ids that a worker remembers.
MEMORY_BYTES = 24 << 20
#: Bytes of text that are encoded at once.
ENCODED_AT_ONCE = 3 << 20

_tokenizers: dict = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts, with a memory of pieces.

    A byte-level pre-tokenizer puts a single space before the token that
    follows it and keeps other white space, letters, digits and signs apart.
    So where all white space of a text that touches a space is that space
    alone, the text may be cut before each space, around line feeds if it has no
    other white space, and before a last sign that follows a letter or digit.
    Each different piece goes through the tokenizer
    once, and a text's ids are gathered from those of its pieces. Other texts
    go through it whole, as do those that hold a special token's string, which
    the tokenizer turns into that token's id.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.keys, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())  # pieces and their ids
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else -1
        self.cuttable = self.feed >= 0 and _is_gpt2_like(path)

    def _packed(self, ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64) * self.dtype.itemsize
        return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())])

    def _whole(self, texts: list[str]) -> pa.Array:
        found = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return self._packed(np.concatenate([np.zeros(0, self.dtype), *found]), np.array([len(x) for x in found], np.int64))

    def _together(self, pieces: list[str], space: str) -> pa.Array:
        """Ids of pieces that neither begin nor end with white space and hold no line feed, many to a text.

        A line feed between two such pieces is a token of its own, whether or
        not a space follows it, and parts their ids.
        """
        found, lengths = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for at in range(0, len(pieces), 500):
            text = space + ("\n" + space).join(pieces[at : at + 500])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            feeds = np.flatnonzero(ids == self.feed)
            found.append(ids[ids != self.feed])
            lengths.append(np.diff(feeds, prepend=-1, append=len(ids)) - 1)
        out = self._packed(np.concatenate(found), np.concatenate(lengths))
        if len(out) != len(pieces):
            raise ValueError("the line feed is no token of its own in this vocabulary")
        return out

    def _learn(self, keys: pa.Array) -> pa.Array:
        """Ids of different pieces; those that no space precedes begin with GLUE."""
        glued = pc.starts_with(keys, GLUE).to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(keys, _ODD).to_numpy(zero_copy_only=False)
        some = [np.flatnonzero(m) for m in (~glued & ~odd, glued & ~odd, ~glued & odd, glued & odd)]
        spaced, bare, odd_spaced, odd_bare = [keys.take(pa.array(at)).to_pylist() for at in some]
        made = [self._together(spaced, " "), self._together([p[1:] for p in bare], ""), self._whole([" " + p for p in odd_spaced]), self._whole([p[1:] for p in odd_bare])]
        return pa.concat_arrays(made).take(pa.array(np.argsort(np.concatenate(some), kind="stable")))

    def _places(self, keys: pa.Array) -> np.ndarray:
        """Where each of different pieces is in the memory; those that aren't yet are put there."""
        if self.keys.nbytes + self.ids.nbytes > MEMORY_BYTES:
            self.keys, self.ids = self.keys[:0], self.ids[:0]
        places = pc.index_in(keys, self.keys)
        new = keys.filter(places.is_null())
        if len(new):
            known = len(self.keys)
            self.ids = pa.concat_arrays([self.ids, self._learn(new)])
            self.keys = pa.concat_arrays([self.keys, new])
            out = places.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            out[out < 0] = known + np.arange(len(new))
            return out
        return places.to_numpy().astype(np.int64)

    def __call__(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text's followed by ``end`` if given, and how many each has."""
        cut = [self.cuttable and regular(t) and GLUE not in t and not any(x in t for x in self.special) for t in texts]
        glued = pa.array([GLUE + _lines_apart(t) if c else GLUE for t, c in zip(texts, cut, strict=True)], pa.large_string())
        lists = pc.split_pattern(pc.replace_substring_regex(glued, _LAST_SIGN, r"\1 " + GLUE + r"\2\3"), " ")
        pieces = lists.flatten().dictionary_encode()
        pick = self._places(pieces.dictionary)[pieces.indices.to_numpy()]
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        # A text that isn't cut is one piece.
        whole = [i for i, c in enumerate(cut) if not c]
        pick[bounds[whole]] = len(self.ids) + np.arange(len(whole))
        table = pa.concat_arrays([self.ids, self._whole([texts[i] for i in whole]), self._packed(np.array([end or 0], self.dtype), np.ones(1, np.int64))])
        if end is not None:
            pick = np.insert(pick, bounds[1:], len(table) - 1)
            bounds = bounds + np.arange(len(bounds))
        joined = table.take(pa.array(pick))
        done = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1] // self.dtype.itemsize
        return np.frombuffer(joined.buffers()[2] or b"", self.dtype)[: done[-1]], np.diff(done[bounds])


#: Stands before a piece that no space precedes.
GLUE = "\x01"
_LAST_SIGN = r"([\p{L}\p{Nd}])([.,;:!?])( |\z)"
#: All white space besides the space.
_OTHER_SPACE = [chr(c) for c in (*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


#: Pieces that hold a line feed, or begin or end with white space, and the empty one.
_ODD = "\n|^{0}?[{1}]|[{1}]$|^{0}?$".format(GLUE, "".join(_OTHER_SPACE))


def _lines_apart(text: str) -> str:
    """The text with single line feeds parted from what stands beside them, if it has no other white space than spaces."""
    if "\n" not in text or "\n\n" in text or text[0] == "\n" or text[-1] == "\n" or any(w in text for w in _OTHER_SPACE if w != "\n"):
        return text
    return text.replace("\n", f" {GLUE}\n {GLUE}")


def _is_gpt2_like(path: str) -> bool:
    """Whether the file says byte-level pre-tokenizing with the usual pattern and no other step that looks at white space."""
    import json

    with open(path) as f:
        made = json.load(f)
    pre = made.get("pre_tokenizer") or {}
    return made.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")


def regular(text: str) -> bool:
    """Whether every space stands between two characters that aren't white space."""
    return not _beside_space(text)


def _beside_space(text: str) -> bool:
    if text[:1] == " " or text[-1:] == " " or "  " in text:
        return True
    return any(w in text and (" " + w in text or w + " " in text) for w in _OTHER_SPACE)


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker."""
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


class ShardWriter:
    """Writes one shard and its index, first under other names, so that a task that runs twice leaves one whole shard."""

    def __init__(self, folder: str, shard: int, dtype: np.dtype, length: int):
        self.fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.final = f"{base}/shard-{shard:06d}"
        self.temporary = f"{base}/_{uuid.uuid4().hex}"
        self.dtype, self.length = dtype, length
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([pa.field("ids", pa.list_(pa.field("id", kind, False), length), False), pa.field("mask", pa.list_(pa.field("real", pa.bool_(), False), length), False)])
        self.sink = self.fs.open_output_stream(f"{self.temporary}.arrow")
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.rest: list[np.ndarray] = []
        self.pending = 0
        self.docs: list[tuple[pa.Array, np.ndarray]] = []
        self.listed, self.before = 0, 0
        self.index = self.index_sink = None
        self.done = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray, docs: pa.Array) -> None:
        """``ids`` of several documents in a row, ``sizes`` of each."""
        self.docs.append((docs, sizes))
        self.listed += len(sizes)
        if self.listed >= INDEX_BATCH:
            self._list()
        self.rest.append(ids)
        self.pending += len(ids)
        if self.pending >= self.length * BATCH:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, self.dtype)
        step = self.length * BATCH
        for at in range(0, len(ids) if last else len(ids) - step + 1, step):
            part = ids[at : at + step]
            real = len(part)
            full = -(-real // self.length) * self.length
            part = np.concatenate([part, np.zeros(full - real, self.dtype)])
            mask = np.packbits(np.arange(full) < real, bitorder="little")
            kinds = [f.type for f in self.schema]
            values = [pa.Array.from_buffers(kinds[0].value_type, full, [None, pa.py_buffer(part.tobytes())]), pa.Array.from_buffers(pa.bool_(), full, [None, pa.py_buffer(mask.tobytes())])]
            self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(v, type=k) for v, k in zip(values, kinds, strict=True)], schema=self.schema))
            self.done = at + step
        self.rest, self.pending = ([], 0) if last else ([ids[self.done :].copy()], len(ids) - self.done)
        self.done = 0

    def _list(self) -> None:
        """Writes the index of the documents added since the last call."""
        sizes = np.concatenate([n for _, n in self.docs]) if self.docs else np.zeros(0, np.int64)
        names = pa.concat_arrays([d for d, _ in self.docs]) if self.docs else pa.array([], pa.int64())
        part = pa.table({"doc_id": names, "start": pa.array(np.cumsum(sizes) - sizes + self.before), "n_tokens": pa.array(sizes)})
        if self.index is None:
            self.index_sink = self.fs.open_output_stream(f"{self.temporary}.index")
            self.index = pa.ipc.new_file(self.index_sink, part.schema)
        self.index.write_table(part)
        self.before += int(sizes.sum())
        self.docs, self.listed = [], 0

    def close(self) -> None:
        self._flush(True)
        self.out.close()
        self.sink.close()
        self._list()
        self.index.close()
        self.index_sink.close()
        self.fs.move(f"{self.temporary}.index", f"{self.final}.index")
        self.fs.move(f"{self.temporary}.arrow", f"{self.final}.arrow")


class ShardReader:
    """Random access to one shard: ``sequence(i)``, ``span(start, n)`` and the index."""

    def __init__(self, folder: str, shard: int):
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        path = f"{base}/shard-{shard:06d}"
        local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        opened = (lambda p: pa.memory_map(p)) if local else fs.open_input_file
        self.file = pa.ipc.open_file(opened(f"{path}.arrow"))
        self.index = pa.ipc.open_file(opened(f"{path}.index"))
        self.length = self.file.schema.field("ids").type.list_size
        self._at, self._ids = -1, None

    def _batch(self, i: int) -> np.ndarray:
        if i != self._at:
            self._at, self._ids = i, self.file.get_batch(i).column("ids").flatten().to_numpy()
        return self._ids

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        batch = self.file.get_batch(i // BATCH)
        at = i % BATCH
        return tuple(batch.column(c).slice(at, 1).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "mask"))

    def span(self, start: int, n: int) -> np.ndarray:
        step, parts = self.length * BATCH, []
        while n > 0:
            i, at = divmod(start, step)
            part = self._batch(i)[at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.uint16)


def write(docs: DataFrame, folder: str, path: str, text: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """Writes the shards of ``docs`` in ascending doc_id order; returns shard, n_docs, n_tokens.

    A null text is an empty one. Rows without doc_id come first; repeated rows
    are all written, equal ids in the order of a hash of their texts. An empty
    table writes no shard. A shard holds about SHARD_BYTES of text at most, but
    for single longer ones. The write happens when the result is first used.
    """
    spark = docs.sparkSession
    narrow = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_text"))
    size = narrow.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    dealt = narrow.repartitionByRange(parts, "doc_id", F.xxhash64("_text")).sortWithinPartitions("doc_id", F.xxhash64("_text")).withColumn("_shard", F.spark_partition_id())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, shard, n_docs, n_tokens = None, 0, 0, 0
        encode = encoder(path)
        for batch in slices(batches, "_text", ENCODED_AT_ONCE, 20_000):
            if made is None:
                shard = batch.column("_shard")[0].as_py()
                made = ShardWriter(folder, shard, encode.dtype, length)
            ids, sizes = encode(batch.column("_text").to_pylist(), end)
            made.add(ids, sizes, batch.column("doc_id"))
            n_docs += len(sizes)
            n_tokens += len(ids)
        if made is not None:
            made.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": [n_docs], "n_tokens": [n_tokens]})

    return dealt.mapInArrow(run, "shard int, n_docs bigint, n_tokens bigint")


def read(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """From the files of ``shards`` (shard, before): doc_id, start, n_tokens, ids_crc32, shard of each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, before in zip(batch.column("shard").to_pylist(), batch.column("before").to_pylist(), strict=True):
                reader = ShardReader(folder, shard)
                for i in range(reader.index.num_record_batches):
                    docs = reader.index.get_batch(i)
                    crcs = [zlib.crc32(reader.span(a, n).astype("<u4").tobytes()) for a, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist(), strict=True)]
                    start = pa.array(docs.column("start").to_numpy() + before)
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id"), start, docs.column("n_tokens"), pa.array(crcs, pa.int64()), pa.array([shard] * len(crcs), pa.int32())], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one_each = shards.select("shard", "before").repartition(parts, "shard")
    return one_each.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, shard int")


def encoded(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Writes ``docs`` and reads them back: doc_id, start, n_tokens, ids_crc32, shard per row.

    The driver sees one row per shard.
    """
    spark = docs.sparkSession
    folder = fresh(spark, "tokens")
    shards = write(docs, folder, path or tokenizer_path(), text).collect()
    made = spark.createDataFrame([(r.shard, r.n_tokens) for r in shards], "shard int, n_tokens bigint")
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return read(spark, folder, made.withColumn("before", before))


def query(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
