"""Alignment of two tokenizers' tokens over the same bytes.

Tokenizer A (byte-level) gets a space and the text, tokenizer B (pieces) gets
the text and adds the space. Both cut the same bytes into intervals. B's
intervals, in order, are a static interval index: two bisections give the first
and the last B token that an A token overlaps. Every gap between two B tokens
that one A token overlaps is spanned; gaps that no A token spans are the
boundaries of groups, the smallest stretches in which tokens of A and of B
cover the same bytes.

A text is cut where both tokenizers end a token for certain: before a single
space or line feed between two characters that aren't white space. A token of A
has white space at its start alone or is all white space, and no piece of B has
its space mark behind another character; a line feed is one of B's byte pieces.
So the tokens of a text are those of its pieces, each different piece is
encoded and aligned once per worker memory, and whole texts are gathered.

Documents are taken in chunks of bounded bytes; a chunk is one row of a written
table with its documents' figures and its different id pairs. Counts of pairs
are summed over chunks and come back to each chunk by joins, so that no table
of all pairs is sent anywhere.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import ragged, slices
from tessella.sources.scratch import written
from tessella.sources.tables import table

#: Pieces that a worker remembers, and characters of them.
MEMORY_PIECES, MEMORY_CHARS = 300_000, 8 << 20
#: Bytes of texts in a chunk, and documents.
CHUNK_BYTES, CHUNK_ROWS = 3 << 20, 4_000
#: Chunks in a file: a writer holds its rows until a hundred are there, and a reader all that a file has of a column.
CHUNKS_A_FILE = 4
#: Links of a group that are laid out at once; the ids of larger groups are counted first.
LAID_OUT = 256

_LATER_SPACE = re.compile(r"[\s᠎​﻿]")
_CUT = re.compile(r"(?<=[^\s᠎​﻿])(?=[ \n][^\s᠎​﻿])")
_ODD = re.compile(r"[\s᠎​﻿]{2}|[^\S \n]|[᠎​﻿]|^\s|\s$")


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spanned_gaps(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Of each gap after a B token, whether an A token spans it. Both cut the same bytes; ends ascend."""
    starts_a = np.concatenate([[0], ends_a[:-1]])
    first = np.searchsorted(ends_b, starts_a, "right")
    last = np.searchsorted(ends_b, ends_a, "left")
    over = np.zeros(len(ends_b) + 1, np.int64)
    np.add.at(over, first, 1)
    np.add.at(over, last, -1)
    return np.cumsum(over[:-1]) > 0


class Vocabularies:
    """The two tokenizers, and the bytes of each of their ids."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        unicode = _byte_letters()
        size = 1 + max(self.a.get_vocab(with_added_tokens=True).values())
        self.bytes_a = [bytes(unicode[c] for c in self.a.id_to_token(i) or "" if c in unicode) for i in range(size)]
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.table_a, self.table_b = pa.array(self.bytes_a, pa.large_binary()), pa.array(self.bytes_b, pa.large_binary())
        if any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(len(self.bytes_b))):
            raise ValueError("a piece of B has a space mark behind another character, so texts can't be cut at spaces")

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode_a(self, raws: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of texts that each begin with a space or a line feed, all in a row, and how many each has.

        Where white space stands at the start alone, many texts go in one, with
        a line feed before each; it is a token of its own there.
        """
        feed = self.a.encode("\n", add_special_tokens=False).ids
        single = np.array([len(feed) == 1 and not _LATER_SPACE.search(r, 1) for r in raws], bool)
        ids, lengths = [], np.zeros(len(raws), np.int64)
        order = [np.flatnonzero(single), np.flatnonzero(~single)]
        for at in range(0, len(order[0]), 500):
            some = order[0][at : at + 500]
            text = "".join(raws[i] if raws[i][0] == "\n" else "\n" + raws[i] for i in some)
            found = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            feeds = np.flatnonzero(found == feed[0])
            if len(feeds) != len(some):
                raise ValueError("the line feed is no token of its own in this vocabulary")
            spaced = np.array([raws[i][0] == " " for i in some])
            lengths[some] = np.diff(feeds, append=len(found)) - spaced
            ids.append(np.delete(found, feeds[spaced]))
        rest = [e.ids for e in self.a.encode_batch_fast([raws[i] for i in order[1]], add_special_tokens=False)]
        lengths[order[1]] = [len(x) for x in rest]
        flat = np.concatenate([np.zeros(0, np.int64), *ids, *[np.array(x, np.int64) for x in rest]])
        if len(rest) == 0:
            return flat, lengths
        placed = np.concatenate(order)
        starts = np.empty(len(raws), np.int64)
        starts[placed] = np.cumsum(lengths[placed]) - lengths[placed]
        return flat[ragged(starts, lengths)], lengths

    def encode_b(self, raws: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """B's ids likewise. Before a line feed, B puts its space mark, which goes."""
        found = self.b.encode([r[1:] if r[0] == " " else r for r in raws], num_threads=1)
        return _runs([ids if r[0] == " " else ids[1:] for ids, r in zip(found, raws, strict=True)])


def _gives_back(ids: np.ndarray, counts: np.ndarray, table: pa.Array, lengths: np.ndarray, raws: list[bytes]) -> np.ndarray:
    """Of each text, whether its tokens' bytes are its own."""
    upto = np.concatenate([[0], np.cumsum(lengths[ids])])[np.concatenate([[0], np.cumsum(counts)])]
    got = table.take(pa.array(ids)).buffers()[2] if len(ids) else None
    got, size = bytes(got or b"")[: upto[-1]], np.fromiter(map(len, raws), np.int64, len(raws))
    if got == b"".join(raws) and (np.diff(upto) == size).all():
        return np.ones(len(raws), bool)
    return np.array([got[a:b] == r for a, b, r in zip(upto[:-1], upto[1:], raws, strict=True)], bool)


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 is itself, the rest comes from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(text: str) -> list[str]:
    """The text's pieces by name: one that is a space and a character that isn't white space is named without its space."""
    if not _ODD.search(text):
        return text.replace("\n", " \n").split(" ")
    return [p[1:] if p[0] == " " and len(p) > 1 and not p[1].isspace() else p for p in _CUT.split(" " + text)]


def _raw(name: str) -> str:
    return name if name[0].isspace() else " " + name


def _sign(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


def _runs(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(lengths.sum())), lengths


def _joined(names: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Decimal ids, joined by commas, of each run that stops at an end."""
    offsets = pa.array(np.concatenate([[0], ends]), pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, names.take(pa.array(ids))), _sign(","))


class Aligner:
    """Aligned pieces, remembered. Arrays hold a row per piece: counts, the written groups, and the id pairs with their links."""

    def __init__(self, path_a: str, path_b: str):
        self.words = Vocabularies(path_a, path_b)
        self.names = pa.array([str(i) for i in range(max(len(self.words.bytes_a), len(self.words.bytes_b)))], pa.large_string())
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.figures = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, whether bytes are the text's
        self.written = pa.array([], pa.large_string())
        self.keys = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int64)
        self.at = np.zeros(1, np.int64)

    def learn(self, new: list[str]) -> None:
        raws = [_raw(n) for n in new]
        ids_a, n_a = self.words.encode_a(raws)
        ids_b, n_b = self.words.encode_b(raws)
        raw_bytes = [r.encode() for r in raws]
        size = np.fromiter(map(len, raw_bytes), np.int64, len(raws))
        good = _gives_back(ids_a, n_a, self.words.table_a, self.words.length_a, raw_bytes) & _gives_back(ids_b, n_b, self.words.table_b, self.words.length_b, raw_bytes)
        if not good.all():  # what doesn't give the text's bytes has no tokens
            keep_a, keep_b = np.repeat(good, n_a), np.repeat(good, n_b)
            ids_a, ids_b = ids_a[keep_a], ids_b[keep_b]
            n_a, n_b, size = n_a * good, n_b * good, size * good
        ends_a, ends_b = np.cumsum(self.words.length_a[ids_a]), np.cumsum(self.words.length_b[ids_b])
        cut_b = np.flatnonzero(~spanned_gaps(ends_a, ends_b)) + 1 if len(ends_b) else np.zeros(0, np.int64)
        cut_a = np.searchsorted(ends_a, ends_b[cut_b - 1], "left") + 1
        groups_upto = np.searchsorted(ends_b[cut_b - 1], np.cumsum(size), "right")
        n_groups = np.diff(groups_upto, prepend=0)
        in_a, in_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
        texts = pc.binary_join_element_wise(_joined(self.names, ids_a, cut_a), _joined(self.names, ids_b, cut_b), _sign("|"))
        per_piece = pa.array(np.concatenate([[0], groups_upto]), pa.int64())
        texts = pc.binary_join(pa.LargeListArray.from_arrays(per_piece, texts), _sign(";"))
        owner, keys, links = self._pairs(ids_a, cut_a - in_a, in_a, ids_b, cut_b - in_b, in_b, np.repeat(np.arange(len(new)), n_groups))
        n_links = np.bincount(owner, links, len(new)).astype(np.int64)
        known = len(self.index)
        self.index.update(zip(new, range(known, known + len(new)), strict=True))
        self.chars += sum(map(len, new))
        self.figures = np.concatenate([self.figures, np.stack([n_a, n_b, n_groups, n_links, good], axis=1).astype(np.int64)])
        self.written = pa.concat_arrays([self.written, texts])
        self.keys, self.links = np.concatenate([self.keys, keys]), np.concatenate([self.links, links])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.bincount(owner, minlength=len(new)))])

    @staticmethod
    def _pairs(ids_a, from_a, in_a, ids_b, from_b, in_b, owner):
        """Piece, id pair and number of links of all groups, in the order of pieces; small groups are laid out, large ones counted by id first."""
        small = in_a * in_b <= LAID_OUT
        na, nb = in_a[small], in_b[small]
        rows = ragged(from_a[small], na)  # A occurrences, each with all B of its group
        beside = np.repeat(nb, na)
        left = np.repeat(ids_a[rows], beside)
        right = ids_b[ragged(np.repeat(from_b[small], na), beside)]
        owners, keys = [np.repeat(owner[small], na * nb)], [left << 32 | right]
        links = [np.ones(len(left), np.int64)]
        for g in np.flatnonzero(~small):
            a, ka = np.unique(ids_a[from_a[g] : from_a[g] + in_a[g]], return_counts=True)
            b, kb = np.unique(ids_b[from_b[g] : from_b[g] + in_b[g]], return_counts=True)
            owners.append(np.full(len(a) * len(b), owner[g]))
            keys.append((a[:, None] << 32 | b[None, :]).ravel())
            links.append((ka[:, None] * kb[None, :]).ravel())
        owners, keys, links = np.concatenate(owners), np.concatenate(keys), np.concatenate(links)
        if len(owners) and not small.all():
            order = np.argsort(owners, kind="stable")
            owners, keys, links = owners[order], keys[order], links[order]
        return owners, keys, links

    def chunk(self, texts: list[str | None]) -> dict:
        """Figures, digest and id pairs (as places in ``keys``, with links) of each text."""
        if len(self.index) > MEMORY_PIECES or self.chars > MEMORY_CHARS:
            self.clear()
        cut = [pieces(t) if t else [] for t in texts]
        self.learn_missing(cut)
        lengths = np.fromiter(map(len, cut), np.int64, len(cut))
        places = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), np.int64, int(lengths.sum()))
        upto = np.concatenate([[0], np.cumsum(lengths)])
        wrong = np.concatenate([[0], np.cumsum(1 - self.figures[places, 4])])
        good = (wrong[upto[1:]] == wrong[upto[:-1]]) & (lengths > 0)
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.figures[places, :4], axis=0)])
        figures = (sums[upto[1:]] - sums[upto[:-1]]) * good[:, None]
        digests = self._digests(places, upto, good)
        many = self.at[places + 1] - self.at[places]
        rows = ragged(self.at[places], many)
        doc = np.repeat(np.repeat(np.arange(len(cut)), lengths), many)
        held = good[doc]
        keys, local = np.unique(self.keys[rows][held], return_inverse=True)
        both, where = np.unique(doc[held] * max(len(keys), 1) + local, return_inverse=True)
        links = np.bincount(where, self.links[rows][held], len(both)).astype(np.int64)
        of, at = both // max(len(keys), 1), both % max(len(keys), 1)
        return {"figures": figures, "digests": digests, "keys": keys, "held": np.bincount(at, minlength=len(keys)).astype(np.int64), "at": at.astype(np.int32), "links": links, "upto": np.searchsorted(of, np.arange(1, len(cut) + 1), "left").astype(np.int64)}

    def learn_missing(self, cut: list[list[str]]) -> None:
        new = set(chain.from_iterable(cut)).difference(self.index.keys())
        if new:
            self.learn(sorted(new))

    def _digests(self, places: np.ndarray, upto: np.ndarray, good: np.ndarray) -> list[str]:
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(upto, pa.int64()), self.written.take(pa.array(places))), _sign(";"))
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1]
        data = memoryview(joined.buffers()[2] or b"")
        return [hashlib.sha256(data[a:b]).hexdigest() if ok else "" for a, b, ok in zip(offsets[:-1], offsets[1:], good, strict=True)]

    def groups(self, text: str | None) -> list[dict]:
        """The groups of one text: byte span in space+text, A ids, B ids; none where bytes differ."""
        cut = pieces(text) if text else []
        self.learn_missing([cut])
        at = [self.index[p] for p in cut]
        if not cut or not self.figures[at, 4].all():
            return []
        found, end = [], 0
        for written_groups in (self.written[i].as_py() for i in at):
            for group in written_groups.split(";"):
                a, b = ([int(i) for i in side.split(",")] for side in group.split("|"))
                start, end = end, end + int(self.words.length_a[a].sum())
                found.append({"start": start, "end": end, "a": a, "b": b})
        return found


_CHUNK = "chunk bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, sha array<string>, keys array<bigint>, held array<bigint>, at array<int>, links array<bigint>, upto array<bigint>"
_RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
_workers: dict = {}


def _aligner(paths: tuple[str, str]) -> Aligner:
    if paths not in _workers:
        _workers[paths] = Aligner(*paths)
    return _workers[paths]


def _chunks(paths: tuple[str, str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, done = _aligner(paths), 0
        base = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", CHUNK_BYTES, CHUNK_ROWS):
            found = aligner.chunk(batch.column("text").to_pylist())
            f = found["figures"]
            row = [pa.array([base + done], pa.int64()), _one(batch.column("doc_id").cast(pa.int64()))]
            row += [_one(pa.array(np.ascontiguousarray(f[:, i]))) for i in range(4)]
            row += [_one(pa.array(found["digests"], pa.string()))]
            row += [_one(pa.array(found[k])) for k in ("keys", "held", "at", "links", "upto")]
            done += 1
            yield pa.RecordBatch.from_arrays(row, names=[c.split()[0] for c in _CHUNK.split(", ")])

    return run


def _one(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _finish(chunk: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of one chunk, whose id pairs' counts are the rows of ``found``."""
    cell = lambda c: chunk.column(c).combine_chunks()[0].values
    upto = np.concatenate([[0], cell("upto").to_numpy()])
    counts, best = np.zeros(len(cell("keys")), np.int64), np.zeros(len(cell("keys")), np.int64)
    place = found.column("place").to_numpy()
    counts[place], best[place] = found.column("n").to_numpy(), found.column("best").to_numpy()
    at, links = cell("at").to_numpy(), cell("links").to_numpy()
    total = np.concatenate([[0], np.cumsum(links * counts[at])])
    most = np.concatenate([[0], np.cumsum(links * best[at])])
    columns = [*[cell(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], pa.array(most[upto[1:]] - most[upto[:-1]]), pa.array(total[upto[1:]] - total[upto[:-1]]), cell("sha")]
    return pa.Table.from_arrays(columns, names=[c.split()[0] for c in _RESULT.split(", ")])


def chunked(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """The written table of chunks."""
    of = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(of.mapInArrow(_chunks(paths or vocabulary_paths()), _CHUNK), "tokens", maxRecordsPerFile=CHUNKS_A_FILE)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``key`` (A id in the upper 32 bits, B id in the lower), ``n``: how many documents hold the pair linked, and whether that is its A id's highest."""
    counts = chunks.select(F.explode(F.arrays_zip("keys", "held")).alias("x")).groupBy(F.col("x.keys").alias("key")).agg(F.sum("x.held").alias("n"))
    counts = written(counts, "pairs")
    top = counts.groupBy(F.shiftright("key", 32).alias("a")).agg(F.max("n").alias("most"))
    return counts.join(top, F.shiftright(counts.key, 32) == top.a).select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; others don't matter): the figures of its alignment.

    Null and empty texts, and texts whose bytes one tokenizer doesn't give
    back, have zeros and an empty digest. Rows with equal or null doc_id are
    documents of their own. An empty table gives an empty result.
    """
    chunks = chunked(docs, paths)
    places = chunks.select("chunk", F.posexplode("keys").alias("place", "key"))
    found = places.join(pair_counts(chunks), "key").select(F.col("chunk").alias("_chunk"), "place", "n", "best")
    # One chunk at a time: batches of joined rows would have as many as a task gets.
    return chunks.drop("held").groupBy("chunk").cogroup(found.groupBy("_chunk")).applyInArrow(_finish, _RESULT)


def groups(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id and ``groups``, each with its byte span in space+text, its A ids and its B ids."""
    found = paths or vocabulary_paths()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(found)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in slices(batches, "text", 1 << 20, 500):
            if len(aligner.index) > MEMORY_PIECES or aligner.chars > MEMORY_CHARS:
                aligner.clear()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([aligner.groups(t) for t in batch.column("text").to_pylist()], kind)], names=["doc_id", "groups"])

    of = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return of.mapInArrow(run, "doc_id bigint, groups array<struct<start: bigint, end: bigint, a: array<int>, b: array<int>>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
