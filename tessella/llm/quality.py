"""Quality rules and robust multivariate outliers, with DataFrame operations only.

Each text gives five counts. Documents that fail a plain rule on them go. Of
the others, a vector of transformed statistics is held against the
minimum-covariance-determinant estimate of its language and source: the mean
and covariance of the share of documents whose covariance has the smallest
determinant, found by concentration steps from two starts (medians and
quartile ranges, and the plain moments). A step takes the Mahalanobis
distances of all documents, finds per group the distance that the wanted
share has at most, and takes the moments of that share anew. Groups with few
documents fall back on their language, then on all documents. Moments and
sketches are pre-aggregated before any shuffle, so a hot group is no hot task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.sources.scratch import written
from tessella.sources.tables import table

WINDOW = 8
#: Plain rules.
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
#: The share of a group that the covariance is concentrated on.
SHARE = 0.75
STEPS = 4
#: Documents a group needs for an estimate of its own.
LEAST_GROUP = 60
#: Quantiles of the chi-square distribution with 4 degrees of freedom at 0.75 and 0.975.
CHI_SHARE, CHI_REWEIGHT = 5.385, 11.143
#: Groups up to which their estimates, some 200 bytes each, are broadcast.
MOST_BROADCAST = 50_000
#: Squared distance from which a document is rejected: the chi-square quantile at 0.9999 with 4 degrees of freedom.
CUTOFF = 23.513
#: The transformed statistics, each with the least standard deviation that a group is taken to have. Of the documents
#: labelled good in testdata/sf0.1, 0.999 lie within 0.93, 0, 1.1 and 3.2 of their group's median, which a deviation
#: of 0.28, 0, 0.33 and 0.96 would give.
FEATURES = {
    "word_length": ("word_chars / n_words", 0.35),
    "symbols": ("ln(1 + 100 * n_symbols / n_words)", 0.35),
    "dup_lines": ("ln(1 + n_dup_lines)", 0.35),
    "repeats": ("ln(1 + 100 * n_repeat_words / n_words)", 1.0),
}
NAMES = tuple(FEATURES)
LEAST = {name: least for name, (_, least) in FEATURES.items()}
#: Columns that the operator makes.
MADE = frozenset({"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept", "d2", "volume", *NAMES, *[f"{k}{i}" for k in "mz" for i in range(4)], *[f"{k}{i}{j}" for k in "cl" for i in range(4) for j in range(4)]})
PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Columns that have a name of MADE, or begin with an underscore, are not
    carried over. A null text has none of anything. The 8-word windows are compared by
    64-bit hashes. A word counts as repeated if it lies in a window that
    occurs twice or more in its text.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in MADE and not c.startswith("_")]
    out = docs.select(*rest, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    out = out.withColumn("_words", F.array_remove(F.split("_t", r"[\x20\x09-\x0D]+"), ""))
    out = out.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("_words")
    out = out.select(
        *rest,
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))).alias("_windows"),
    )
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = out.withColumn("_sorted", F.when(again, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: (x["h"] == F.get("_sorted", k - 1)["h"]) | (x["h"] == F.get("_sorted", k + 1)["h"])
    starts = F.transform("_sorted", lambda x, k: F.when(same(x, k), x["i"]))
    out = out.withColumn("_starts", F.sort_array(F.array_compact(starts)))
    reach = F.transform("_starts", lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", k + 1) - v, F.lit(WINDOW))))
    covered = F.aggregate(reach, F.lit(0).cast("bigint"), lambda a, v: a + v)
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("_windows", "_sorted", "_starts")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _factor(groups: DataFrame, least: Mapping[str, float]) -> DataFrame:
    """Cholesky factor of each group's covariance, no deviation being less than its ``least``."""
    out = groups
    for i, name in enumerate(NAMES):
        for j in range(i + 1):
            left = F.coalesce(F.col(f"c{i}{j}"), F.lit(0.0))
            for k in range(j):
                left = left - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.greatest(F.sqrt(F.greatest(left, F.lit(0.0))), F.lit(float(least[name]))) if i == j else left / F.col(f"l{j}{j}"))
    volume = sum((F.log(f"l{i}{i}") for i in range(len(NAMES))), F.lit(0.0))
    return out.withColumn("volume", volume).drop(*[f"c{i}{j}" for i, j in PAIRS])


def _distance(rows: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance by the centre m and factor l of the row."""
    out = rows
    for i, name in enumerate(NAMES):
        left = F.col(name) - F.col(f"m{i}")
        for k in range(i):
            left = left - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", left / F.col(f"l{i}{i}"))
    squares = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(len(NAMES))), F.lit(0.0))
    return out.withColumn("d2", squares).drop(*[f"z{i}" for i in range(len(NAMES))])


def _moments() -> list[Column]:
    return [F.avg(c).alias(f"m{i}") for i, c in enumerate(NAMES)] + [F.covar_pop(NAMES[i], NAMES[j]).alias(f"c{i}{j}") for i, j in PAIRS]


KEY = ("level", "key_lang", "key_source")


def _group_keys(lang: str, source: str) -> Column:
    """The groups of a row: language and source, language, all; '' and '=' keep null apart from any value."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    key = lambda level, a, b: F.struct(F.lit(level).alias("level"), a.alias("key_lang"), b.alias("key_source"))
    return F.array(key(2, named(lang), named(source)), key(1, named(lang), F.lit("")), key(0, F.lit(""), F.lit("")))


def _joinable(groups: DataFrame) -> DataFrame:
    """A table of groups, to be broadcast while its rows are few."""
    return F.broadcast(groups) if groups.count() <= MOST_BROADCAST else groups


def estimates(rows: DataFrame, lang: str = "lang", source: str = "source", steps: int = STEPS, least: Mapping[str, float] = LEAST) -> DataFrame:
    """Robust centre and factor of every group of ``rows`` (FEATURES and the two keys) with documents enough."""
    spread = rows.select(*NAMES, F.explode(_group_keys(lang, source)).alias("_")).select(*NAMES, *[F.col(f"_.{c}").alias(c) for c in KEY])
    first = spread.groupBy(*KEY).agg(F.count("*").alias("n"), *[F.percentile_approx(c, [0.25, 0.5, 0.75], 2_000).alias(f"q{i}") for i, c in enumerate(NAMES)], *_moments())
    first = written(first.where((F.col("n") >= LEAST_GROUP) | (F.col("level") == 0)), "quality")
    plain = first.select(*KEY, F.lit(0).alias("start"), *[f"m{i}" for i in range(len(NAMES))], *[f"c{i}{j}" for i, j in PAIRS])
    middle = first.select(
        *KEY,
        F.lit(1).alias("start"),
        *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(len(NAMES))],
        *[(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2.0) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS],
    )
    groups = written(_factor(plain.unionByName(middle), least), "quality")
    by = [*KEY, "start"]
    for step in range(steps + 1):
        far = _distance(spread.join(_joinable(groups), list(KEY)).select(*by, *NAMES, *[f"m{i}" for i in range(len(NAMES))], *[f"l{i}{j}" for i, j in PAIRS]))
        if step < steps:
            edge = written(far.groupBy(*by).agg(F.percentile_approx("d2", SHARE, 2_000).alias("edge")), "quality")
        else:  # the last step takes all that lie near by the concentrated estimate, made consistent
            edge = written(far.groupBy(*by).agg((F.percentile_approx("d2", SHARE, 2_000) / CHI_SHARE * CHI_REWEIGHT).alias("edge")), "quality")
            edge = edge.withColumn("edge", F.greatest("edge", F.lit(CHI_REWEIGHT)))
        near = far.join(_joinable(edge), by).where(F.col("d2") <= F.col("edge"))
        groups = written(_factor(near.groupBy(*by).agg(*_moments()), least), "quality")
    best = groups.groupBy(*KEY).agg(F.min_by(F.struct(*[f"m{i}" for i in range(len(NAMES))], *[f"l{i}{j}" for i, j in PAIRS]), F.struct("volume", "start")).alias("_"))
    return best.select(*KEY, "_.*")


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF, least: Mapping[str, float] = LEAST) -> DataFrame:
    """``docs`` without the text, with the five counts, base_failed, distance and kept.

    ``least``: for each statistic, the least deviation that a group is taken to
    have; set it from documents known to be good, as at FEATURES.

    A document that fails a plain rule is not kept and has no distance. Rows
    with a null language or source form groups of their own. Repeated rows all
    count and all stay. An empty table gives none.
    """
    features = [F.expr(sql).alias(name) for name, (sql, _) in FEATURES.items()]
    stats = written(counts(docs, text).withColumn("base_failed", base_failed()), "quality")
    sound = stats.where(~F.col("base_failed"))
    groups = estimates(sound.select(lang, source, *features), lang, source, least=least)
    known = written(groups, "quality")
    keyed = sound.select("*", *features).withColumn("_keys", _group_keys(lang, source))
    few = known.count() <= MOST_BROADCAST
    fine = known.select(F.struct(*KEY).alias("_key"), F.struct(*[c for c in known.columns if c not in KEY]).alias("_fit"))
    out = keyed
    for k in range(3):
        side = fine.withColumnsRenamed({"_key": f"_key{k}", "_fit": f"_fit{k}"})
        out = out.join(F.broadcast(side) if few else side, F.col("_keys")[k] == F.col(f"_key{k}"), "left").drop(f"_key{k}")
    out = out.withColumn("_fit", F.coalesce("_fit0", "_fit1", "_fit2"))
    columns = [c for c in stats.columns]
    far = _distance(out.select(*columns, *NAMES, "_fit.*")).withColumn("distance", F.round("d2", 6)).select(*columns, "distance")
    failed = stats.where("base_failed").withColumn("distance", F.lit(None).cast("double"))
    return far.unionByName(failed).withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= cutoff))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
