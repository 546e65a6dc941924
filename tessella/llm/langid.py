"""Language of documents by inference of a mixture.

Each learned language has a table of trigram likelihoods (bytes of lower-cased
words, with word ends). A document is a mixture: each word comes from one of
its languages, in proportions that expectation-maximisation estimates from the
words' n-gram likelihoods. The set of languages is the one whose likelihood,
less half the logarithm of the number of words for each language after the
first, is highest: beginning with the likeliest single language, the set grows
by the language that raises that most, until none does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import packed_rows, ragged, slices
from tessella.sources.tables import table

UNDETERMINED = "und"
#: Entries of a language's table; trigrams are hashed onto them.
TABLE = 1 << 16
#: Labelled documents of each language that are learned from, in the mean; a bounded sample by a hash of doc_id.
SAMPLE = 3_000
FOLDS, HELD_OUT = 5, 0
SMOOTHING = 0.2
#: Share of a word's likelihood that any language gives it, for names and typing errors.
BACKGROUND = 1e-6
ROUNDS = 12

_LETTER = regex.compile(r"\p{L}")
_SEPARATOR = np.uint8(32)
_BYTES = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # TABLE x languages, float32 logarithms

    @classmethod
    def learned(cls, counts: dict[str, np.ndarray]) -> Model:
        languages = sorted(counts)
        logs = [np.log((counts[k] + SMOOTHING) / (counts[k].sum() + SMOOTHING * TABLE)) for k in languages]
        return cls(languages, np.stack(logs, 1).astype(np.float32) if logs else np.zeros((TABLE, 0), np.float32))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; one without doc_id is."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(True))


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram at each letter of all texts; where each word starts among them; words of each text."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    x = _BYTES[np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)]
    letter = x != _SEPARATOR
    at = np.flatnonzero(letter)
    wide = x.astype(np.uint32)
    mixed = (wide[at - 1] * np.uint32(0x9E3779B1)) ^ (wide[at] * np.uint32(0x85EBCA77)) ^ (wide[at + 1] * np.uint32(0xC2B2AE3D)) if len(at) else np.zeros(0, np.uint32)
    grams = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    starts = np.flatnonzero(~letter[at - 1]) if len(at) else np.zeros(0, np.int64)
    ends = np.cumsum([len(p) + 1 for p in parts])
    words = np.diff(np.searchsorted(at[starts], ends, "right"), prepend=0)
    return grams, starts, words


def count(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Trigram counts of each ``lang`` of (lang, _text); at most TABLE numbers a language reach the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in slices(batches, "_text"):
            langs = batch.column("lang").to_pylist()
            texts = batch.column("_text").to_pylist()
            for lang in set(langs):
                grams, _, _ = trigrams([t for t, k in zip(texts, langs, strict=True) if k == lang])
                found[lang] = found.get(lang, 0) + np.bincount(grams, minlength=TABLE)
        for lang, n in found.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(some), "gram": pa.array(some.astype(np.int32)), "n": pa.array(n[some].astype(np.int64))})

    out: dict[str, np.ndarray] = {}
    rows = labelled.select("lang", "_text").mapInArrow(run, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    for lang, gram, n in zip(rows["lang"].to_pylist(), rows["gram"].to_pylist(), rows["n"].to_pylist(), strict=True):
        out.setdefault(lang, np.zeros(TABLE, np.int64))[gram] = n
    return out


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """Learns from text and non-null lang of the documents that aren't held out.

    Languages with many documents give a sample of about ``sample``. Where
    there are no labelled rows the model knows no language.
    """
    usable = docs.select("doc_id", "lang", F.col(text).alias("_text")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("_text").isNotNull())
    sizes = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    large = {k: sample / n for k, n in sizes.items() if n > sample}
    if large:
        share = F.coalesce(F.create_map(*[F.lit(x) for kv in large.items() for x in kv])[F.col("lang")], F.lit(1.0))
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    counts = count(usable)
    for lang in sizes:
        counts.setdefault(lang, np.zeros(TABLE, np.int64))
    return Model.learned(counts)


def _mixture(p: np.ndarray, words: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions per text by expectation-maximisation, their log-likelihood, and a bound on the best one's.

    ``p``: likelihoods, words x languages; ``words``: words of each text, none
    without any; ``allowed``: texts x languages. The bound holds as the
    likelihood is concave in the proportions.
    """
    starts = np.cumsum(words) - words
    share = allowed / allowed.sum(1, keepdims=True)
    of = np.repeat(np.arange(len(words)), words)
    for last in [*[False] * ROUNDS, True]:
        mixed = (share[of] * p).sum(1)
        gain = np.add.reduceat(p / mixed[:, None], starts, axis=0)
        if not last:
            share = share * gain / words[:, None]
    log = np.add.reduceat(np.log(mixed), starts)
    slack = np.maximum((gain * (allowed > 0)).max(1) - words, 0)
    return share, log, log + slack


def infer(model: Model, texts: list[str | None]) -> list[tuple[str, float, str]]:
    """Language, its proportion, and all proportions of each text."""
    out: list[tuple[str, float, str]] = [(UNDETERMINED, 0.0, "")] * len(texts)
    some = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
    n_langs = len(model.languages)
    if not some or not n_langs:
        return out
    grams, starts, words = trigrams([texts[i] for i in some])
    has = np.flatnonzero(words)
    some, words = [some[i] for i in has], words[has]
    if not some:
        return out
    logs = np.add.reduceat(model.table[grams], starts, axis=0).astype(np.float64)
    best = logs.max(1)
    p = np.exp(logs - best[:, None]) * (1 - BACKGROUND) + BACKGROUND
    first = np.cumsum(words) - words
    alone = np.add.reduceat(np.log(p), first, axis=0)
    share = np.zeros((len(some), n_langs))
    share[np.arange(len(some)), alone.argmax(1)] = 1.0
    score = alone.max(1)
    if n_langs > 1:
        cost = 0.5 * np.log(np.maximum(words, 2))
        _, _, bound = _mixture(p, words, np.ones((len(some), n_langs)))
        member = share > 0
        open_ = np.flatnonzero(bound - cost > score)  # no set of two or more can be better for the others
        for k in range(1, n_langs):
            rows = ragged(first[open_], words[open_])
            q, w, own = p[rows], words[open_], member[open_]
            best_value, best_share, added = score[open_].copy(), share[open_].copy(), np.full(len(open_), -1)
            for j in range(n_langs):
                can = np.flatnonzero(~own[:, j] & (bound[open_] - k * cost[open_] > best_value))
                if not len(can):
                    continue
                allowed = own[can].astype(float)
                allowed[:, j] = 1.0
                part = ragged((np.cumsum(w) - w)[can], w[can])
                mixed, log, _ = _mixture(q[part], w[can], allowed)
                value = log - k * cost[open_[can]]
                better = value > best_value[can]
                best_value[can[better]], best_share[can[better]], added[can[better]] = value[better], mixed[better], j
            grown = np.flatnonzero(added >= 0)
            open_, added = open_[grown], added[grown]
            score[open_], share[open_] = best_value[grown], best_share[grown]
            member[open_, added] = True
            if not len(open_):
                break
    for row, i in enumerate(some):
        top = int(share[row].argmax())
        parts = sorted(((v, model.languages[k]) for k, v in enumerate(share[row]) if v >= 0.005), key=lambda x: (-x[0], x[1]))
        out[i] = (model.languages[top], float(min(1.0, share[row, top])), " ".join(f"{k}:{v:.2f}" for v, k in parts))
    return out


def identified(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``lang_pred``, ``score``, ``mixture`` of every row.

    ``text`` is a column, or the field ``_row.name`` of a kept struct. A null
    text, or one without a letter, is ``und`` with score 0, as is every text
    if the model knows no language. Of equally likely languages the first in
    code-point order is taken. Repeated rows stay; an empty table gives none.
    """
    column, _, field = text.partition(".")
    narrow = docs.select(*keep, *([] if field else [F.col(text).alias("_text")]))
    schema = docs.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit("").alias("mixture")).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TABLE floats a language

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = pc.struct_field(whole.column(column), field) if field else whole.column("_text")
            told = pa.RecordBatch.from_arrays([*[whole.column(c) for c in keep], texts], names=[*keep, "_text"])
            for batch in slices([told], "_text", 1 << 20):
                found = infer(shared.value, batch.column("_text").to_pylist())
                lang, score, mixture = (list(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(mixture, pa.string())], names=[*keep, "lang_pred", "score", "mixture"])

    return narrow.mapInArrow(run, schema)


def rejected(lang_pred: Column) -> Column:
    """The stage's decision: documents without any letter go."""
    return lang_pred == UNDETERMINED


def keep_identified(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which a language is found, with the columns they had.

    If nothing is labelled, no row is rejected for want of a model: only those
    without a letter go.
    """
    model = fit(docs, text)
    if not model.languages:
        return docs.where(F.col(text).rlike(r"\p{L}"))
    found = identified(packed_rows(docs), model, f"_row.{text}", ("_row",))
    return found.where(~rejected(F.col("lang_pred"))).select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identified(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "mixture")
