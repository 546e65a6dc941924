"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Test items are taken in blocks of bounded size. Every n-gram of an item is a
seed, with its words in a row or with a gap before the last, however many documents have it, so an item that has leaked, whole, in
part or edited, into much of the corpus is found in all of it. One pass joins
the documents' n-grams to the seeds. Around the hits of an item, the most that
an alignment could score is taken from which words the item has at all; where
that is enough, the words are aligned with the item's. Both sides of the joins
are hashes: seeds are a sorted array behind a bit map, documents are hashed
whole texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import packed_rows, ragged, row_key, slices
from tessella.sources.scratch import written
from tessella.sources.tables import table

#: Words of a seed.
SEED_WORDS = 3
#: Bytes of items that are taken at once; with their hashes they stay well under what is safe to broadcast.
BLOCK_BYTES = 16 << 20
#: Hits, and words around them, that a task has in memory at once, but for single documents with more.
PIECE = 1 << 21
#: Cells of a row of alignments, over all passages of a batch, and passages' words that wait for alignment at once.
CELLS, WAITING = 1 << 18, 1 << 21
#: Words of a segment of a document whose hits are of so many items that those that can't be there are left out first.
SEGMENT = 512
#: Alignment scores.
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
#: A document contains an item if the alignment scores this share of the item's words, or this many: a passage of over 50 words is a
#: leak however long its item is. This is part of what "contains" means, as is the next.
SHARE, ENOUGH = 0.5, 50.0
#: Items of up to so many words must be there whole, as half of so few words is chance.
SHORT_ITEM = 8
#: Words around a window, as a share of the item's.
SLACK = 0.25

_P = np.uint64(0x100000001B3)
_BITS = 22

_WORD_BYTE = np.zeros(256, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _WORD_BYTE[_b] = 1


class Words:
    """Hashes of the words of several texts. Words are runs of letters and digits, lower-cased; ASCII and common other punctuation parts them."""

    def __init__(self, texts: list[str]):
        parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        x = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
        word = _WORD_BYTE[x].astype(bool)
        # Latin-1 signs (C2 80..BF), general punctuation (E2 80..81) and CJK punctuation (E3 80 80..BF).
        c2 = np.flatnonzero(x == 0xC2)
        word[c2], word[c2 + 1] = False, False
        for lead, low, high in ((0xE2, 0x80, 0x81), (0xE3, 0x80, 0x80)):
            at = np.flatnonzero(x == lead)
            at = at[(x[at + 1] >= low) & (x[at + 1] <= high)]
            for k in range(3):
                word[at + k] = False
        edge = np.diff(word.view(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # Polynomial hashes from one running sum: the sum over a word, scaled back by its start.
        mixed = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        length = ends - starts
        at = ragged(starts, length)
        place = at - np.repeat(starts, length)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(length.max()) if len(length) else 0, _P)]).astype(np.uint64))
        self.hashes = np.add.reduceat(mixed[at] * power[place], np.cumsum(length) - length) if len(starts) else np.zeros(0, np.uint64)
        doc_ends = np.cumsum([len(p) + 1 for p in parts])
        self.counts = np.diff(np.searchsorted(starts, doc_ends, "right"), prepend=0) if parts else np.zeros(0, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)])

    def grams(self, pattern: tuple[int, ...]) -> np.ndarray:
        """Hash of the words at the pattern's places from each word on, across all texts."""
        h, n = self.hashes, pattern[-1] + 1
        out = np.full(max(0, len(h) - n + 1), n, np.uint64)
        for k in pattern:
            out = (out + h[k : len(h) - n + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
        return out


def patterns(n: int) -> list[tuple[int, ...]]:
    """Places of the words of seeds: n in a row, and n of which the last but one is left out, which finds copies with every n-th word changed."""
    return [tuple(range(n)), (*range(n - 1), n)]


class Seeds:
    """Which hashes are in a set: a bit map, then a search in the sorted set."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.map = np.zeros(1 << _BITS, bool)
        self.map[(self.sorted >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of those in the set, and their places in it."""
        some = np.flatnonzero(self.map[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        at = np.searchsorted(self.sorted, hashes[some])
        hit = self.sorted[np.minimum(at, len(self.sorted) - 1)] == hashes[some] if len(self.sorted) else np.zeros(0, bool)
        return some[hit], at[hit]


def _of_item(item: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of (item, word)."""
    out = (words ^ ((item.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Items:
    """A block of test items: ids, word hashes, which item has which words, and for each seed its items and where it stands in them."""

    ids: list
    words: list[np.ndarray]
    needed: np.ndarray
    vocabulary: Seeds
    times: np.ndarray  # of each (item, word) of the vocabulary: how often the item has the word
    owner: np.ndarray  # its item
    word_of: np.ndarray  # and its word, as a place in ``known``
    known: Seeds  # all words of items
    seeds: Seeds
    first: np.ndarray  # of each seed, in the next three: one entry for each item that has it
    item_of: np.ndarray
    early: np.ndarray  # its first and last place in the item
    late: np.ndarray

    @classmethod
    def made(cls, ids: list, texts: list[str], n: int) -> Items:
        words = Words(texts)
        own = [words.hashes[a:b] for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True)]
        item = np.repeat(np.arange(len(ids)), words.counts)
        vocabulary = Seeds(_of_item(item, words.hashes))
        entry = vocabulary.find(_of_item(item, words.hashes))[1] if len(item) else np.zeros(0, np.int64)
        times = np.bincount(entry, minlength=len(vocabulary.sorted))
        owner, word_of, known = np.zeros(len(times), np.int64), np.zeros(len(times), np.int64), Seeds(words.hashes)
        owner[entry], word_of[entry] = item, np.searchsorted(known.sorted, words.hashes)
        found = []
        for pattern in patterns(n):
            grams = words.grams(pattern)
            at = np.flatnonzero(np.arange(len(grams)) + pattern[-1] < words.offsets[1:][item[: len(grams)]])
            found.append((grams[at], item[at], at - words.offsets[item[at]]))
        gram, who, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((place, who, gram))
        gram, who, place = gram[order], who[order], place[order]
        at = order
        starts = np.flatnonzero((np.diff(gram, prepend=0) != 0) | (np.diff(who, prepend=-1) != 0)) if len(at) else at
        ends = np.append(starts[1:], len(at)) - 1 if len(at) else at
        seeds = Seeds(gram)
        first = np.append(np.searchsorted(gram[starts], seeds.sorted), len(starts))
        return cls(ids, own, np.array([needed(len(w)) for w in own]), vocabulary, times, owner, word_of, known, seeds, first, who[starts], place[starts], place[ends])

    def able(self, words: np.ndarray) -> np.ndarray:
        """Of each item, whether a passage of these words could contain it: counting each word as often as both have it."""
        at, word = self.known.find(words)
        held = np.bincount(word, minlength=len(self.known.sorted)) if len(at) else np.zeros(len(self.known.sorted), np.int64)
        shared = np.minimum(self.times, held[self.word_of])
        return np.bincount(self.owner, shared, len(self.ids)) * MATCH >= self.needed


def align_all(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smith-Waterman scores of pairs of word sequences (item, passage), many at a time.

    Item words are taken one after another, for all passages of a batch; a run
    of gaps along a passage is a running maximum. Two rows are in memory.
    """
    out = np.zeros(len(pairs))
    order = sorted((k for k, (a, b) in enumerate(pairs) if len(a) and len(b)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    at = 0
    while at < len(order):
        wide, end = 0, at
        while end < len(order) and (end == at or max(wide, len(pairs[order[end]][1])) * (end - at + 1) <= CELLS and len(pairs[order[end]][0]) <= 2 * len(pairs[order[at]][0])):
            wide = max(wide, len(pairs[order[end]][1]))
            end += 1
        some = order[at:end]
        at, long = end, max(len(pairs[k][0]) for k in some)
        # Places past an end hold what no other place does, so they match nothing.
        item, passage = np.zeros((len(some), long), np.uint64), np.zeros((len(some), wide), np.uint64)
        real_item, real = np.zeros((len(some), long), bool), np.zeros((len(some), wide), bool)
        for row, k in enumerate(some):
            a, b = pairs[k]
            item[row, : len(a)], real_item[row, : len(a)] = a, True
            passage[row, : len(b)], real[row, : len(b)] = b, True
        slope = np.arange(wide, dtype=np.float32) * np.float32(-GAP)
        last, best = np.zeros((len(some), wide + 1), np.float32), np.zeros(len(some), np.float32)
        for i in range(long):
            gain = np.where((passage == item[:, i : i + 1]) & real & real_item[:, i : i + 1], np.float32(MATCH), np.float32(MISMATCH))
            here = np.maximum(np.maximum(last[:, :-1] + gain, last[:, 1:] + np.float32(GAP)), np.float32(0.0))
            last[:, 1:] = np.maximum.accumulate(here + slope, axis=1) - slope
            np.maximum(best, last.max(axis=1), out=best)
        out[some] = best
    return out


def align(item: np.ndarray, passage: np.ndarray) -> float:
    """Smith-Waterman score of two sequences of word hashes."""
    return float(align_all([(item, passage)])[0])


def needed(length: int) -> float:
    """Score from which a document contains an item of so many words."""
    if length <= SHORT_ITEM:
        return float(length)
    return min(SHARE * length, ENOUGH) if SHARE * length > SHORT_ITEM else float(SHORT_ITEM)


def ceilings(items: Items, words: Words, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The most that an alignment of each item within the words low to high can score.

    A word that the item has gains a match at best, any other costs the least
    penalty; no alignment scores more than the best stretch of such gains, nor
    more than all words counted as often as both sides have them.
    """
    out, ends, a = np.zeros(len(item)), np.cumsum(high - low), 0
    while a < len(item):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PIECE, "right")))
        length = high[a:b] - low[a:b]
        place, who = ragged(low[a:b], length), np.repeat(np.arange(b - a), length)
        gain = np.full(len(place), max(MISMATCH, GAP))
        hit, entry = items.vocabulary.find(_of_item(item[a:b][who], words.hashes[place]))
        gain[hit] = MATCH
        both, held = np.unique(who[hit] * len(items.times) + entry, return_counts=True)
        shared = np.bincount(both // max(len(items.times), 1), np.minimum(held, items.times[both % max(len(items.times), 1)]), b - a)
        after = np.cumsum(gain)
        apart = who * (2.0 * len(place) + 2.0)  # so that the running least begins anew with each stretch
        least = np.minimum.accumulate(after - gain - apart) + apart
        out[a:b] = np.minimum(np.maximum.reduceat(after - least, np.cumsum(length) - length), shared * MATCH)
        a = b
    return out


def matches(items: Items, texts: list[str], n: int) -> Iterator[tuple[int, int, float]]:
    """(text, item, score) for each item that a text contains."""
    words = Words(texts)
    found = []
    for pattern in patterns(n):
        at, seed = items.seeds.find(words.grams(pattern))
        doc = np.searchsorted(words.offsets, at, "right") - 1
        inside = at + pattern[-1] < words.offsets[doc + 1]
        found.append((at[inside], seed[inside], doc[inside]))
    at, seed, doc = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(at, kind="stable")
    at, seed, doc = at[order], seed[order], doc[order]
    many = np.cumsum(items.first[seed + 1] - items.first[seed])
    a = 0
    while a < len(at):  # whole documents
        b = int(np.searchsorted(many, (many[a - 1] if a else 0) + PIECE, "right"))
        if b < len(at):
            b = int(np.searchsorted(doc, doc[b], "left"))
        if b <= a:
            b = int(np.searchsorted(doc, doc[a], "right"))
        if b - a > 1 and many[b - 1] - (many[a - 1] if a else 0) > PIECE:
            yield from _by_segments(items, words, at[a:b], seed[a:b], int(doc[a]))
        else:
            yield from _aligned(items, words, at[a:b], seed[a:b], doc[a:b])
        a = b


def _by_segments(items: Items, words: Words, at: np.ndarray, seed: np.ndarray, doc: int) -> Iterator[tuple[int, int, float]]:
    """One document whose hits have more items than a task holds at once: a segment at a time, with the items that its words allow.

    A segment's words reach as far around its hits as any item's alignment does, so no item that is there is left out.
    """
    longest = max(map(len, items.words))
    reach = longest + int(longest * SLACK) + 2
    best: dict[int, float] = {}
    begin, stop = int(words.offsets[doc]), int(words.offsets[doc + 1])
    for low in range(begin, stop, SEGMENT):
        a, b = np.searchsorted(at, [low, low + SEGMENT])
        if a == b:
            continue
        able = items.able(words.hashes[max(begin, low - reach) : min(stop, low + SEGMENT + reach)])
        while a < b:  # hits of bounded numbers of able items, or one hit
            held = np.concatenate([[0], np.cumsum(able[items.item_of])])
            more = np.cumsum(held[items.first[seed[a:b] + 1]] - held[items.first[seed[a:b]]])
            end = a + max(1, int(np.searchsorted(more, PIECE, "right")))
            for _, item, score in _aligned(items, words, at[a:end], seed[a:end], np.full(end - a, doc), able):
                best[item] = max(score, best.get(item, 0.0))
            a = end
    for item, score in best.items():
        yield doc, item, score


def _aligned(items: Items, words: Words, at: np.ndarray, seed: np.ndarray, doc: np.ndarray, able_items: np.ndarray | None = None) -> Iterator[tuple[int, int, float]]:
    # One row per hit and item: the words among which the item would stand.
    if able_items is None:
        many = items.first[seed + 1] - items.first[seed]
        pick = ragged(items.first[seed], many)
    else:
        kept = np.flatnonzero(able_items[items.item_of])
        low = np.searchsorted(kept, items.first[seed])
        many = np.searchsorted(kept, items.first[seed + 1]) - low
        pick = kept[ragged(low, many)]
    if not len(pick):
        return
    at, doc, item = np.repeat(at, many), np.repeat(doc, many), items.item_of[pick]
    size = np.array([len(w) for w in items.words])[item]
    slack = (size * SLACK).astype(np.int64) + 2
    low = np.maximum(words.offsets[doc], at - items.late[pick] - slack)
    high = np.minimum(words.offsets[doc + 1], at - items.early[pick] + size + slack)
    order = np.lexsort((high, low, item, doc))
    doc, item, low, high = doc[order], item[order], low[order], high[order]
    # Rows of one text and item that overlap are one stretch.
    new = (np.diff(doc, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0)
    apart = np.cumsum(new) * (len(words.hashes) + 1)
    reach = np.maximum.accumulate(high + apart)
    new[1:] |= low[1:] + apart[1:] > reach[:-1]
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], len(new))
    able = ceilings(items, words, item[starts], low[starts], (reach - apart)[stops - 1]) >= items.needed[item[starts]]
    scores: dict[tuple[int, int], float] = {}
    waiting: list[tuple[int, int]] = []
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def settle() -> None:
        for key, score in zip(waiting, align_all(pairs).tolist(), strict=True):
            scores[key] = max(score, scores.get(key, 0.0))
        waiting.clear()
        pairs.clear()

    for a, b in zip(starts[able].tolist(), stops[able].tolist(), strict=True):
        d, k = int(doc[a]), int(item[a])
        own = items.words[k]
        until = -1
        i = a
        while i < b:  # rows that overlap are aligned once
            start, end = int(low[i]), int(high[i])
            while i + 1 < b and int(low[i + 1]) <= end and end - start < 4 * len(own) + 64:
                i += 1
                end = max(end, int(high[i]))
            i += 1
            if end > until:
                waiting.append((d, k))
                pairs.append((own, words.hashes[start:end]))
                until, held = end, held + end - start
                if held > WAITING:
                    settle()
                    held = 0
    settle()
    for (d, k), best in scores.items():
        if best >= items.needed[k]:
            yield d, k, best / len(items.words[k])


def _blocks(items: DataFrame) -> Iterator[tuple[list, list[str]]]:
    """Items in blocks of bounded size, one at a time on the driver."""
    rows = items.select(F.col("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    parts = max(1, -(-total // BLOCK_BYTES))
    for k in range(parts):
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        if mine:
            yield [r.item_id for r in mine], [r.text for r in mine]


def contaminated(docs: DataFrame, items: DataFrame, n: int = SEED_WORDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document and item that it contains: the kept columns, item_id, score.

    ``score`` is the alignment's score over the item's number of words. Null
    texts contain nothing and an item without text, or with fewer words than a
    seed, is contained in nothing. A repeated document or item gives repeated
    rows. Items of up to SHORT_ITEM words must be contained whole.
    """
    spark = docs.sparkSession
    narrow = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    kind = items.schema["item_id"].dataType
    schema = narrow.select(*keep, F.lit(0).alias("_item"), F.lit(0.0).alias("score")).schema
    out = None
    for ids, texts in _blocks(items):
        shared = spark.sparkContext.broadcast(Items.made(ids, texts, n))  # bounded by BLOCK_BYTES

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "_text", 2 << 20):
                found = list(matches(shared.value, batch.column("_text").to_pylist(), n))
                if found:
                    doc, item, score = (np.array(x) for x in zip(*found, strict=True))
                    rows = batch.take(pa.array(doc))
                    yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], pa.array(item.astype(np.int32)), pa.array(score.astype(np.float64))], names=[*keep, "_item", "score"])

        names = spark.createDataFrame(list(enumerate(ids)), f"_item int, item_id {kind.simpleString()}")
        hits = narrow.mapInArrow(run, schema).join(names, "_item").select(*keep, "item_id", F.round("score", 4).alias("score"))
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return narrow.select(*keep, F.lit(None).cast(kind).alias("item_id"), F.lit(0.0).alias("score")).where("false")
    return out


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item, with the columns they had.

    Rows are told by doc_id and a hash of the text, so null and repeated ids do no harm.
    """
    held = packed_rows(docs).select("_row", *row_key())
    narrow = held.select(F.col("_row.text").alias("text"), "_id", "_hash")
    bad = contaminated(narrow, items, keep=("_id", "_hash")).select(F.col("_id").alias("_bad_id"), F.col("_hash").alias("_bad_hash")).distinct()
    bad = written(bad, "leaks")
    return held.join(bad, (F.col("_id") == F.col("_bad_id")) & (F.col("_hash") == F.col("_bad_hash")), "left_anti").select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
