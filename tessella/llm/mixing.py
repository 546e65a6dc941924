"""Mixing sources to target weights, with DataFrame operations only.

The words of a source's documents form one stream, packed into blocks of
``block`` words; the last is short. A source's target is turned into slots:
whole passes over its blocks, then a part of one more pass. Each pass takes
the blocks in a pseudorandom order of its own (swap-or-not, a permutation of
0..n-1 for any n that needs no table), so slot j of a source is a block
number, and slots join blocks by source and number. Output shards draw how
many slots they take of each source from the multinomial law conditioned on
the targets: every slot of a source is a trial that falls into one of the
shards by an independent hash. A shard then takes, of each source's slots in
order, the next as many as it drew, so that the draw decides which blocks it
has. All counts are those of the slots that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import WORD, null_safe_join, packed_rows, running
from tessella.sources.scratch import written
from tessella.sources.tables import table

#: Words of a block.
BLOCK = 256
#: Slots of an output shard, in the mean.
SHARD_SLOTS = 4_096
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
#: Trials that one row of a draw stands for.
TRIALS = 4_096
#: Rounds of the permutation.
ROUNDS = 30
SEED = 20_240_701


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, size, key of every row; a null text has size 0. The key is a hash of the text."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), F.xxhash64(text).alias("key"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> DataFrame:
    """Adds ``weight`` and ``target`` to (source, source_size), one row per source.

    Sources by code point, null last, take the weights in turn. All share
    ``share`` of all sizes by weight; no target is above ``most`` times its
    source's size, and what a source can't take is shared out anew among the
    others. The level at which that settles is found in one pass over the
    sources in the order in which they fill up.
    """
    turn = Window.orderBy(F.col("source").isNull(), F.col("source"))
    out = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights))) + 1))
    out = out.withColumn("_cap", F.col("source_size") * float(most)).withColumn("_fills", F.col("_cap") / F.col("weight"))
    whole = Window.partitionBy()
    filling = Window.orderBy("_fills", F.col("source").isNull(), "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("_goal", F.sum("source_size").over(whole) * share)
    out = out.withColumn("_left", F.col("_goal") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    out = out.withColumn("_open", F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    out = out.withColumn("_level", F.col("_left") / F.col("_open"))
    # Once the level lies under where a source fills up, it holds for all that follow.
    level = F.min(F.when(F.col("_level") <= F.col("_fills"), F.struct("_fills", "_level"))).over(whole)["_level"]
    out = out.withColumn("_settled", level)
    target = F.least(F.col("_cap"), F.coalesce(F.col("weight") * F.col("_settled"), F.col("_cap")))
    return out.withColumn("target", target).select(*sources.columns, "weight", "target")


def permuted(x: Column, n: Column, *key: Column, rounds: int = ROUNDS, inverse: bool = False) -> Column:
    """Image of x under a pseudorandom permutation of 0..n-1 that the key picks."""

    def swap(at: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, F.lit(SEED), i), n) - at, n)
        coin = F.xxhash64(*key, i, F.greatest(at, other)).bitwiseAND(F.lit(1))
        return F.when(coin == 1, other).otherwise(at)

    order = F.sequence(F.lit(rounds), F.lit(1)) if inverse else F.sequence(F.lit(1), F.lit(rounds))
    return F.aggregate(order, x.cast("bigint"), swap)


def draws(plan: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """source, shard, drawn, first for (source, slots): how many slots each shard draws of each source, and where they begin.

    Another ``seed`` draws other counts; the targets are met by any.

    Shards have ``shard_slots`` slots in the mean. A source's trials are dealt
    out in runs, so that no row grows with the source, and counted before they
    are shuffled.
    """
    spark = plan.sparkSession
    every = plan.agg(F.greatest(F.lit(1), F.ceil(F.sum("slots") / shard_slots)).cast("bigint").alias("shards"))
    runs = plan.where("slots > 0").crossJoin(F.broadcast(every)).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("slots") - 1) / TRIALS).cast("bigint"))))  # one row
    runs = runs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source", "_run")
    trials = runs.select("source", "shards", F.explode(F.sequence(F.col("_run") * TRIALS, F.least(F.col("_run") * TRIALS + (TRIALS - 1), F.col("slots") - 1))).alias("_trial"))
    shard = F.pmod(F.xxhash64(F.lit("shard"), F.lit(seed), "source", "_trial"), F.col("shards")).cast("bigint")
    drawn = trials.groupBy("source", shard.alias("shard")).agg(F.count("*").alias("drawn"))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return drawn.withColumn("first", F.coalesce(F.sum("drawn").over(before), F.lit(0)).cast("bigint"))


def slots(sources: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """source, slot, pass, block, take, shard for every slot of (source, source_size, target).

    ``take`` is how many words of the block the slot takes: all, but for the
    last slot of a source, which takes what is left of the target.
    """
    goal = F.round("target").cast("bigint")
    n = F.ceil(F.col("source_size") / block).cast("bigint")
    plan = sources.where("source_size > 0").select("source", "source_size", goal.alias("goal"), n.alias("n"))
    plan = plan.withColumn("passes", F.floor(F.col("goal") / F.col("source_size")).cast("bigint")).withColumn("rest", F.col("goal") - F.col("passes") * F.col("source_size"))
    # Where the short block comes in the last pass decides how many slots the rest needs.
    plan = plan.withColumn("short_at", permuted(F.col("n") - 1, F.col("n"), F.col("source"), F.col("passes"), inverse=True))
    plan = plan.withColumn("missing", F.col("n") * block - F.col("source_size"))
    early = F.ceil(F.col("rest") / block)
    late = F.ceil((F.col("rest") + F.col("missing")) / block)
    plan = plan.withColumn("extra", F.when(F.col("rest") == 0, 0).when(early <= F.col("short_at"), early).otherwise(F.least(late, F.col("n"))).cast("bigint"))
    total = written(plan.withColumn("slots", F.col("passes") * F.col("n") + F.col("extra")), "sources")
    drawn = null_safe_join(written(draws(total.select("source", "slots"), shard_slots, seed), "draws"), total, ["source"], "inner")
    numbered = drawn.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("drawn") - 1)))
    out = numbered.withColumn("pass", F.floor(F.col("slot") / F.col("n")).cast("bigint")).withColumn("_at", F.col("slot") % F.col("n"))
    out = out.withColumn("block", permuted(F.col("_at"), F.col("n"), F.col("source"), F.col("pass")))
    long = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    before = F.col("_at") * block - F.when(F.col("short_at") < F.col("_at"), F.col("missing")).otherwise(0)
    take = F.when(F.col("pass") < F.col("passes"), long).otherwise(F.least(long, F.col("rest") - before))
    return out.select("source", "slot", "pass", "block", take.cast("bigint").alias("take"), "shard")


#: What orders the documents of a source's stream; rows that agree in it have equal words.
STREAM = ["doc_id", "key"]


def packed(docs: DataFrame) -> DataFrame:
    """Adds ``start``: where the document's words begin in its source's stream, for (doc_id, source, size, key)."""
    return running(docs, ["source"], STREAM, F.col("size"), "start")


def _placed(docs: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Documents with start and target, and their pieces by block."""
    at = packed(docs)
    sources = written(targets(docs.groupBy("source").agg(F.sum("size").alias("source_size"))), "sources")
    return written(null_safe_join(at, sources, ["source"]), "packed"), sources


def mixed(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, key, source_size, weight, target, taken, first_shard, last_shard for rows of (doc_id, source, size, key).

    The shards' draws decide in which shards a document's words stand, of
    which the first and the last are given (null if the mix takes none of its words).

    Null sources are one source; documents without words are taken 0 times.
    Repeated rows count one by one, each with its own place in the stream.
    Equal input gives equal output; an empty table gives none.
    """
    at, sources = _placed(written(docs.select("doc_id", "source", "size", "key"), "sizes"), block)
    drawn = written(slots(sources, block, shard_slots, seed), "slots")  # written, so that the planner knows how many they are
    # A block is drawn by up to MOST_PASSES + 1 slots, all with different takes at most.
    per = drawn.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("take", "shard"))).alias("takes"))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = at.where("size > 0").withColumn("block", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    low = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    pieces = null_safe_join(pieces.withColumn("_low", low).withColumn("_high", high), per, ["source", "block"])
    held = F.transform(F.filter("takes", lambda t: t["take"] > F.col("_low")), lambda t: t["shard"])
    words = F.aggregate("takes", F.lit(0).cast("bigint"), lambda a, t: a + F.greatest(F.least(t["take"], F.col("_high")) - F.col("_low"), F.lit(0)))
    columns = ["doc_id", "source", "size", "key", "source_size", "weight", "target"]
    ends = [F.min(F.array_min(held)).alias("first_shard"), F.max(F.array_max(held)).alias("last_shard")]
    some = pieces.groupBy(*columns, "start").agg(F.coalesce(F.sum(words), F.lit(0)).cast("bigint").alias("taken"), *ends).select(*columns, "taken", "first_shard", "last_shard")
    none = F.lit(None).cast("bigint")
    return some.unionByName(at.where("size = 0").select(*columns, F.lit(0).cast("bigint").alias("taken"), none.alias("first_shard"), none.alias("last_shard")))


def blocks(docs: DataFrame, text: str = "text", block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mixture itself: shard, source, slot, and ``words``, the words that the slot takes of its block.

    Slots join packed blocks by source and block number. A block's words come
    in the order of the stream.
    """
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "source", words.alias("_words"), F.xxhash64(text).alias("key")).withColumn("size", F.size("_words").cast("bigint"))
    at = packed(rows)
    sources = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "sources")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    cut = at.where("size > 0").withColumn("block", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    low = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    high = F.least((F.col("block") + 1) * block - F.col("start"), F.col("size"))
    part = F.slice("_words", (low + 1).cast("int"), (high - low).cast("int"))
    filled = cut.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("start", part.alias("w")))).alias("parts"))
    filled = filled.select("source", "block", F.flatten(F.transform("parts", lambda p: p["w"])).alias("_block"))
    out = null_safe_join(written(slots(sources, block, shard_slots, seed), "slots"), filled, ["source", "block"])
    return out.select("shard", "source", "slot", F.slice("_block", F.lit(1), F.col("take").cast("int")).alias("words"))


def repeated(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` as often as the mixture takes them, with the columns they had.

    Documents stay whole: one of which the slots take t words out of n comes
    ⌊t/n⌋ times, and once more with the chance of the remainder, decided by a
    hash of its doc_id, its text and its place in the input. Rows that agree
    in doc_id, source and text share their words. Documents without words stay
    once. Nulls are values of their own, no column's name matters, and an
    empty table gives none.
    """
    taken = mixed(sized(docs, text)).groupBy("doc_id", "source", "key", "size").agg(F.avg("taken").alias("_taken"))
    plan = taken.select(*[F.col(c).alias(f"_plan_{c}") for c in ("doc_id", "source", "key")], "size", "_taken")
    rows = packed_rows(docs).withColumn("_key", F.xxhash64(f"_row.{text}")).withColumn("_place", F.monotonically_increasing_id())
    same = F.col("_row.doc_id").eqNullSafe(F.col("_plan_doc_id")) & F.col("_row.source").eqNullSafe(F.col("_plan_source")) & (F.col("_key") == F.col("_plan_key"))
    chance = F.pmod(F.xxhash64("_plan_doc_id", "_key", "_place", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("_taken") / F.col("size") + chance)).cast("int")
    out = rows.join(plan, same).withColumn("_times", times).where("_times > 0")
    return out.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixed(sized(docs)).select("doc_id", "size", "source_size", "target", "taken", "source", "first_shard", "last_shard")
