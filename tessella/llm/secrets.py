"""Secrets in texts: plain patterns, and novelty against a primed Zstandard compressor.

Three patterns give the base spans. The method adds strings that stand in a
sensitive context and that nothing known explains: the compressor is primed
with a dictionary of the corpus's identifiers, and a candidate's marginal cost
is the compressed size of its surroundings with it less that without it. A name,
a path or a phrase is put together from the dictionary or from the surroundings
and costs little; a key costs about as many bytes as its alphabet needs. Other
copies of the candidate are taken out of the surroundings first, so that a key
that is written twice doesn't explain itself.

The dictionary holds runs of letters, by the number of documents that have them
in all the corpus, the rarest first and the most frequent last, where
the compressor reaches them cheapest. Its size is bounded, so it goes to every
task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log2

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import slices
from tessella.sources.scratch import forget, written
from tessella.sources.tables import table

# The base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ("assign", "access", "hex", "novel")

#: What makes a context sensitive: one of these stands so many code points before the candidate at most, on its line.
SENSITIVE = "password passwd passphrase pwd secret token apikey api_key api-key access_key access-key private_key private-key client_key credential credentials authorization bearer signature"
REACH = 48
#: Candidates: runs of so many signs or more, of two classes of letters and digits at least.
CANDIDATE_LEAST = 16
#: Code points on either side that the compressor sees first.
SURROUNDINGS = 256
#: Share of the bytes that an incompressible string of the candidate's alphabet needs.
NOVEL = 0.85
#: Bytes of the dictionary that stand before all that is compressed.
LEAD = 24
#: Identifiers of the dictionary, documents that have each at least, and bytes of all.
IDENTIFIERS, IDENTIFIER_DOCS, DICTIONARY_BYTES = 12_000, 3, 112_640

_WORDS = re.compile("(?<![A-Za-z])(?:" + "|".join(sorted(SENSITIVE.split(), key=len, reverse=True)) + ")s?(?![A-Za-z])", re.ASCII | re.IGNORECASE)
_CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=.~-])[A-Za-z0-9+/_=.~-]{{{CANDIDATE_LEAST},}}")
_IDENTIFIER = re.compile("[A-Za-z]{4,24}")
#: No text without a match of these holds a span, but the patterns above decide.
_MAYBE = r"(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]key|private[_-]key|client_key|credential|authorization|bearer|signature)|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"
#: Different identifiers that a task counts before it hands them on.
COUNTED = 200_000


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start, end (code points) of what the patterns find, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    # Shorter runs never are part of a longer one, so they may be left out at once.
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return [(KINDS[kind], start, end) for start, kind, end in sorted(found)]


_LONG_HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")


class Novelty:
    """A compressor that is primed with identifiers."""

    def __init__(self, dictionary: bytes):
        settings = {"compression_params": zstandard.ZstdCompressionParameters.from_level(9, min_match=3, write_content_size=False, write_checksum=False)}
        if len(dictionary) >= 8:
            settings["dict_data"] = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings["dict_data"].precompute_compress(compression_params=settings["compression_params"])
        compressor = zstandard.ZstdCompressor(**settings)
        lead = dictionary[-LEAD:]  # a match in both sizes: what the first one costs beyond its own bytes doesn't count
        self.size = lambda data: len(compressor.compress(lead + data))

    def score(self, text: str, start: int, end: int) -> float:
        """Marginal compressed bytes of text[start:end] as a share of what a random string of its alphabet needs."""
        candidate = text[start:end]
        around = (text[max(0, start - SURROUNDINGS) : start] + text[end : end + SURROUNDINGS]).replace(candidate, "").encode("utf-8", "surrogatepass")
        marginal = self.size(around + candidate.encode()) - self.size(around)
        return marginal / (len(candidate) * log2(_alphabet(candidate)) / 8)


def _alphabet(text: str) -> int:
    """How many signs a string like this draws from."""
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", text):
        return 16 if re.search("[A-Fa-f]", text) else 10
    classes = (("[a-z]", 26), ("[A-Z]", 26), ("[0-9]", 10), ("[^A-Za-z0-9]", 6))
    return sum(n for pattern, n in classes if re.search(pattern, text))


def _candidates(text: str) -> Iterator[tuple[int, int]]:
    """Starts and ends of the strings in sensitive contexts, each once."""
    done = -1
    for word in _WORDS.finditer(text):
        line = text.find("\n", word.end())
        stop = min(len(text) if line < 0 else line, word.end() + REACH)
        for m in _CANDIDATE.finditer(text, word.end()):
            if m.start() > stop:
                break
            if m.start() < done or (m.start() == stop and stop < word.end() + REACH):
                continue
            done = m.end()
            found = m.group().rstrip(".=-/_~")
            end = m.start() + len(found) + (len(m.group()) - len(m.group().rstrip("=")) if m.group().endswith("=") else 0)
            left = text.rfind(" ", 0, m.start()) + 1
            if "://" in text[max(left, m.start() - 200) : m.start() + 1] or "//" in found or text[end : end + 1] in ("@", ":"):
                continue  # an address
            classes = sum(bool(re.search(c, found)) for c in ("[a-z]", "[A-Z]", "[0-9]"))
            if len(found) >= CANDIDATE_LEAST and classes >= 2:
                yield m.start(), end


def spans_of(text: str | None, novelty: Novelty, least: float = NOVEL) -> list[tuple[str, int, int, float | None]]:
    """Kind, start, end and score (null for base spans) of all spans, by start, then kind. Spans of the method overlap no base span."""
    if not text:
        return []
    base = base_spans(text)
    found = [(*b, None) for b in base]
    for start, end in _candidates(text):
        if not any(s < end and start < e for _, s, e in base):
            score = novelty.score(text, start, end)
            if score >= least:
                found.append((KINDS[3], start, end, score))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    for batch in slices(batches, "text"):
        for text in batch.column("text").to_pylist():
            counts.update(set(_IDENTIFIER.findall(text or "")))
        if len(counts) > COUNTED:
            yield pa.RecordBatch.from_pydict({"word": [*counts], "n": pa.array(counts.values(), pa.int64())})
            counts = Counter()
    yield pa.RecordBatch.from_pydict({"word": pa.array([*counts], pa.string()), "n": pa.array(counts.values(), pa.int64())})


def identifiers(docs: DataFrame) -> DataFrame:
    """``word``, ``n``: runs of 4 to 24 letters and how many documents have them."""
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, most: int = IDENTIFIERS, at_least: int = IDENTIFIER_DOCS) -> bytes:
    """The identifiers of most documents (ties by letters), the most frequent last.

    First, the words are counted by eighths of powers of two of their
    frequency, a few hundred rows; only words from the range on that the last
    identifier falls in are ordered, so a task sends few to the driver.
    """
    counted = written(identifiers(docs).where(F.col("n") >= at_least), "identifiers")
    level = F.floor(F.log2("n") * 8)
    least, held = 0, 0
    for row in counted.groupBy(level.alias("level")).count().orderBy(F.col("level").desc()).collect():
        least, held = row.level, held + row["count"]
        if held >= most:
            break
    top = counted.where(level >= least).orderBy(F.col("n").desc(), "word").limit(most).collect()
    forget(counted)
    kept, size = [], 0
    for row in top:
        size += len(row.word) + 1
        if size > DICTIONARY_BYTES:
            break
        kept.append(row.word)
    return " ".join(reversed(kept)).encode()


_SCANNED = "doc_id bigint, secrets array<struct<kind: string, start: bigint, end: bigint, score: double>>"


def scan(docs: DataFrame, primed: bytes | None = None, least: float = NOVEL) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; others don't matter): doc_id and ``secrets``, all spans in code points.

    ``primed`` is the dictionary, that of ``docs`` itself if not given. Null
    and empty texts have no spans; repeated rows and null ids stay as they are;
    an empty table gives an empty result.
    """
    primed = dictionary(docs) if primed is None else primed
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(primed)
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            at = pc.fill_null(pc.match_substring_regex(texts, _MAYBE), False).to_numpy(zero_copy_only=False).nonzero()[0]
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i, text in zip(at.tolist(), texts.take(pa.array(at)).to_pylist(), strict=True):
                found[i] = [dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans_of(text, novelty, least)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "secrets"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCANNED)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("secrets", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("secrets")).alias("spans"))
