"""Spelling variants by forward and backward minimal acyclic automata.

Two words are near if one inserted, deleted or replaced code point makes one of
the other. With h as half the shorter word's length, rounded down, near words
have the same first h code points or the same last h: the one error lies
outside one of the two halves. So words are dealt by a half, each word under
the halves that it can share with a near word, and what falls under one half
is looked up where it is dealt.

There, the words of many halves make one minimal acyclic automaton, and the
reversed words of the others a second one. Each transition holds how many
words come before those behind it, so a path through the automaton numbers the
word that it spells, in sorted order, without a hash table of words. A query
matches its half exactly and completes the rest with one error. A pair that
shares both halves is counted forward only, so that no pair counts twice.

Halves with more than ``MOST`` words are cut into pieces; every word of the
half is a query in each of them, so nothing is lost.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import slices
from tessella.sources.scratch import forget, written
from tessella.sources.tables import table

#: Runs that are words after A-Z are lower-cased.
RUN = "[a-z\\u00C0-\\u00FF]+"
#: Words have so many code points and occurrences at least; h is half of the shorter word, so LEAST // 2 at least.
LEAST, OCCURRENCES = 6, 5
#: A word is a variant of a near word that is so many times as frequent.
RATIO = 5
#: One in so many different runs of a document loses a code point.
PLANTED = 199
#: Words of one half that are looked up together, and words that make one automaton.
MOST, BATCH = 100_000, 50_000
#: Different words that a task counts before it hands them on.
COUNTED = 200_000


class Automaton:
    """Minimal acyclic automaton of sorted, different words, with word numbers.

    ``arcs[s]`` maps a character to the next state and to how many words of
    state s sort before those behind it; the final state's own word sorts first.
    """

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.words: list[int] = []
        known: dict[tuple, int] = {}
        open_arcs: list[list[tuple[str, int]]] = [[]]
        open_final, last = [False], ""

        def close(depth: int) -> None:
            while len(open_arcs) > depth + 1:
                arcs, final = tuple(open_arcs.pop()), open_final.pop()
                state = known.get((final, arcs))
                if state is None:
                    state = known[final, arcs] = self._state(final, arcs)
                open_arcs[-1].append((last[len(open_arcs) - 1], state))

        for word in words:
            same = 0
            for x, y in zip(word, last):  # noqa: B905
                if x != y:
                    break
                same += 1
            close(same)
            for _ in word[same:]:
                open_arcs.append([])
                open_final.append(False)
            open_final[-1] = True
            last = word
        close(0)
        self.start = self._state(open_final[0], tuple(open_arcs[0]))

    def _state(self, final: bool, arcs: tuple[tuple[str, int], ...]) -> int:
        before, out = int(final), {}
        for sign, state in arcs:
            out[sign] = (state, before)
            before += self.words[state]
        self.arcs.append(out)
        self.final.append(final)
        self.words.append(before)
        return len(self.arcs) - 1

    def walk(self, state: int, number: int, text: str, at: int = 0) -> tuple[int, int]:
        """The state and number after the text from ``at`` on; state -1 if there is no such path."""
        arcs = self.arcs
        for sign in text[at:] if at else text:
            step = arcs[state].get(sign)
            if step is None:
                return -1, 0
            state, number = step[0], number + step[1]
        return state, number

    def one_error(self, half: str, rest: str) -> set[int]:
        """Numbers of the words that begin with ``half`` and go on as ``rest`` with exactly one code point inserted, deleted or replaced."""
        state, number = self.walk(self.start, 0, half)
        found: set[int] = set()
        arcs, final, size, walk = self.arcs, self.final, len(rest), self.walk
        at = 0
        while state >= 0:
            here = rest[at] if at < size else None
            if here is not None:
                s, n = walk(state, number, rest, at + 1)  # without this code point
                if s >= 0 and final[s]:
                    found.add(n)
            for sign, (after, before) in arcs[state].items():
                s, n = walk(after, number + before, rest, at)  # with another before it
                if s >= 0 and final[s]:
                    found.add(n)
                if here is not None and sign != here:  # with another in its place
                    s, n = walk(after, number + before, rest, at + 1)
                    if s >= 0 and final[s]:
                        found.add(n)
            if here is None:
                break
            step = arcs[state].get(here)
            if step is None:
                break
            state, number, at = step[0], number + step[1], at + 1
        return found


def runs_of(doc_id: int | None, text: str | None) -> Counter[str]:
    """Occurrences of the words of one document, those that are too short left out."""
    base = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    counts: Counter[str] = Counter()
    lowered = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    for run, n in Counter(_LONG.findall(lowered)).items():
        h = zlib.crc32(run.encode(), base)
        if h % PLANTED == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
            if len(run) < LEAST:
                continue
        counts[run] += n
    return counts


_LONG = re.compile(f"{RUN[:-1]}{{{LEAST},}}")


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    for batch in slices(batches, "text"):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for word, n in runs_of(doc_id, text).items():
                counts[word] += n
        if len(counts) > COUNTED:
            yield pa.RecordBatch.from_pydict({"word": [*counts], "n": pa.array(counts.values(), pa.int64())})
            counts = Counter()
    yield pa.RecordBatch.from_pydict({"word": pa.array([*counts], pa.string()), "n": pa.array(counts.values(), pa.int64())})


def words(docs: DataFrame) -> DataFrame:
    """``word``, ``n`` of all words that are long and frequent enough. Null texts hold none; a null doc_id hashes as an empty one."""
    of = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = of.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= OCCURRENCES)


def _dealt(counted: DataFrame, most: int) -> DataFrame:
    """A row per word, half and piece: which half, how long it is, and whether the word is in the piece's automaton and a query of it."""
    size = F.char_length("word")
    halves = F.array_distinct(F.array(F.floor((size - 1) / 2), F.floor(size / 2)))
    rows = counted.select("word", "n", F.explode(F.filter(halves, lambda h: h >= LEAST // 2)).alias("h"))
    rows = rows.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("backward"))
    half = F.when(F.col("backward"), F.expr("right(word, int(h))")).otherwise(F.expr("left(word, int(h))"))
    rows = rows.withColumn("key", F.xxhash64("backward", "h", half))
    large = rows.groupBy("key").agg(F.count("*").alias("_k")).where(F.col("_k") > most)
    # Halves with more than ``most`` words: fewer than rows / most of them.
    rows = rows.join(F.broadcast(large), "key", "left").withColumn("_pieces", F.coalesce(F.ceil(F.col("_k") / most), F.lit(1)).cast("int"))
    own = F.pmod(F.xxhash64("word"), F.col("_pieces")).cast("int")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
    return rows.select("key", "piece", "backward", F.col("h").cast("int").alias("h"), "word", "n", (F.col("piece") == own).alias("held"), (F.col("_pieces") > 1).alias("cut"))


_FOUND = "word string, n_near bigint, best_n bigint, best string"


def _look_up(batch: list[tuple[bool, int, str, int, bool]]) -> pa.RecordBatch:
    counts = {word: n for _, _, word, n, _ in batch}
    out: list[tuple[str, int, int, str]] = []
    for backward in (False, True):
        queries = [(h, word) for b, h, word, _, _ in batch if b == backward]
        turn = (lambda w: w[::-1]) if backward else (lambda w: w)
        held = sorted({turn(word) for b, _, word, _, held in batch if held and b == backward})
        if not held:
            continue
        automaton = Automaton(held)
        for h, word in queries:
            turned, near, best_n, best = turn(word), 0, -1, ""
            for number in automaton.one_error(turned[:h], turned[h:]):
                other = turn(held[number])
                if min(len(word), len(other)) // 2 != h or (backward and other[:h] == word[:h]):
                    continue  # another half has this pair
                near += 1
                n = counts[other]
                if n > best_n or (n == best_n and other < best):
                    best_n, best = n, other
            if near:
                out.append((word, near, best_n, best))
    columns = list(zip(*out, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], names=["word", "n_near", "best_n", "best"])


def _search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of key and piece; batches end where a piece ends. A piece of a cut half is a batch of its own: together, pieces would find a pair again."""
    kept: list[tuple[bool, int, str, int, bool]] = []
    last = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "piece", "cut", "backward", "h", "word", "n", "held")]
        for key, piece, cut, *row in zip(*columns, strict=True):
            if (key, piece, cut) != last:
                if kept and (len(kept) >= BATCH or cut or last[2]):
                    yield _look_up(kept)
                    kept = []
                last = (key, piece, cut)
            kept.append(tuple(row))
    if kept:
        yield _look_up(kept)


def near_words(counted: DataFrame, most: int = MOST) -> DataFrame:
    """Per word of ``counted`` (word, n): n_near, and the most frequent near word with its count, ties by code points; null if none."""
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt(counted, most).repartition(parts, "key", "piece").sortWithinPartitions("key", "piece")
    found = dealt.mapInArrow(_search, _FOUND)
    every = counted.selectExpr("word", "n", "0L AS n_near", "cast(null AS bigint) AS best_n", "cast(null AS string) AS best")
    both = every.unionByName(found.selectExpr("word", "cast(null AS bigint) AS n", "n_near", "best_n", "best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))))
    return both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("_best")).select("word", "n", "n_near", F.col("_best.word").alias("best"), (-F.col("_best.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` for every row of ``forms`` (word, form): the end of the path of forms. Paths double each round; there are no circles, as counts grow."""
    now = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = now.alias("a").join(now.alias("b"), F.col("a.root") == F.col("b.word"), "left")
        after = written(on.select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("_moved")), "forms")
        moved = after.where("_moved").limit(1).count()
        forget(now)
        if not moved:
            return after.select("word", "root")
        now = after.drop("_moved")
        now._written_to = after._written_to


def variants(docs: DataFrame, most: int = MOST) -> DataFrame:
    """Per word: its form (the near word of which it is a variant, or null), the root of its path of forms, and counts.

    ``docs`` has doc_id and text; other columns don't matter. Repeated rows
    count as often as they come. An empty table gives an empty result.
    """
    counted = written(words(docs), "words")
    near = near_words(counted, most)
    is_form = F.col("best_n") >= RATIO * F.col("n")
    near = written(near.select("word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "near")
    found = roots(near.where("form IS NOT NULL"))
    return near.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
