"""Shards by balanced label propagation.

Documents with equal texts are linked. Linked documents start in shards by a
hash; in each round a document asks for the shard where most of its group
is, and as many of those that ask move as the quotas of that shard allow, in
an order by hash. Singles and what found no place then fill the shards, so
that the counts of rows differ by one at most. Groups are joined by key and
counts, so links are never spelled out as pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import join_hot, running
from tessella.sources.scratch import forget, written
from tessella.sources.tables import table

SHARDS = 8
ROUNDS = 6
#: Bins of the hash order in which requests are granted.
BINS = 4_096


def _group(text: Column) -> list[Column]:
    """Key of equal texts: 64-bit hash, checksum and size together; null is a text of its own."""
    return [F.xxhash64(text).alias("g1"), F.coalesce(F.crc32(text.cast("binary")), F.lit(-1)).alias("g2"), F.coalesce(F.octet_length(text), F.lit(-1)).cast("bigint").alias("g3")]


GROUP = ["g1", "g2", "g3"]


def propagate(linked: DataFrame, room: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Shards of linked rows (key, spot, g1, g2, g3): at most ``room`` rows in each; shard is null for those that find no place.

    Each round is one aggregate by group and shard, one join back to the rows,
    and an aggregate over shards x BINS. The driver sees a number per shard
    and bin.
    """
    at = written(linked.withColumn("shard", F.pmod(F.xxhash64("spot", F.lit(7)), F.lit(shards)).cast("int")), "labels")
    total = at.count()
    for _ in range(rounds):
        held = at.groupBy(*GROUP, "shard").agg(F.count("*").alias("n"))
        most = F.max_by("shard", F.when(F.col("shard").isNotNull(), F.struct("n", -F.col("shard"))))
        wanted = held.groupBy(*GROUP).agg(most.alias("want"), F.sum("n").alias("members"))
        wanted = written(wanted.withColumn("want", F.coalesce("want", F.pmod(F.xxhash64(*GROUP), F.lit(shards)).cast("int"))), "wanted")
        asks = join_hot(at, wanted, GROUP, "members", total)
        # Requests are granted by group, so that what cannot all move at least moves together.
        asks = asks.withColumn("bin", F.pmod(F.xxhash64(*GROUP, F.lit(11)), F.lit(BINS)).cast("int"))
        asks = asks.withColumn("sub", F.pmod(F.xxhash64("spot", F.lit(13)), F.lit(BINS)).cast("int"))
        asks = written(asks, "labels")
        forget(at)
        forget(wanted)
        limits = _granted(asks, room, shards)
        moved = asks.join(F.broadcast(limits), "want", "left")  # one row per shard
        stays = F.col("shard") == F.col("want")
        goes = (F.col("bin") < F.col("edge")) | ((F.col("bin") == F.col("edge")) & (F.col("sub") < F.col("sub_edge")))
        moved = written(moved.select("key", "spot", *GROUP, F.when(goes | stays, F.col("want")).otherwise(F.col("shard")).alias("shard"), (goes & ~F.coalesce(stays, F.lit(False))).alias("moved")), "labels")
        forget(asks)
        at = moved.drop("moved")
        at._written_to = moved._written_to
        if moved.where("moved").isEmpty():
            break
    return _evicted(at, room, shards)


def _granted(asks: DataFrame, room: int, shards: int) -> DataFrame:
    """Per wanted shard the bin, and the place in that bin, up to which requests are granted.

    What a shard may take in is its room less the rows that want to stay
    there; those that want to leave make way, for those without a place yet
    are placed last.
    """
    stay = {r.shard: r.n for r in asks.where("shard = want").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    come = asks.where("shard IS NULL OR shard <> want")
    per = {(r.want, r.bin): r.n for r in come.groupBy("want", "bin").agg(F.count("*").alias("n")).collect()}
    rows = []
    for s in range(shards):
        free, edge, split = room - stay.get(s, 0), BINS, None
        for b in range(BINS):
            n = per.get((s, b), 0)
            if n > free:
                edge, split = b, free
                break
            free -= n
        rows.append((s, edge, split))
    cut = {(s, e): f for s, e, f in rows if f}
    subs = {}
    if cut:
        chosen = come.where(" OR ".join(f"(want = {s} AND bin = {e})" for s, e in cut))
        found: dict[tuple[int, int], list] = {}
        for r in chosen.groupBy("want", "bin", "sub").agg(F.count("*").alias("n")).collect():
            found.setdefault((r.want, r.bin), []).append((r.sub, r.n))
        for key, parts in found.items():
            left, subs[key] = cut[key], 0
            for sub, n in sorted(parts):
                if n > left:
                    break
                left, subs[key] = left - n, sub + 1
    return asks.sparkSession.createDataFrame([(s, e, subs.get((s, e), 0)) for s, e, _ in rows], "want int, edge int, sub_edge int")


def _evicted(at: DataFrame, room: int, shards: int) -> DataFrame:
    """Takes the place from rows of shards beyond their room, by hash of the group."""
    over = [r.shard for r in at.groupBy("shard").agg(F.count("*").alias("n")).collect() if r.shard is not None and r.n > room]
    if not over:
        return at
    full = running(at.where(F.col("shard").isin(over)), ["shard"], [*GROUP, "spot"], F.lit(1), "_place", ("key",))
    cut = full.withColumn("shard", F.when(F.col("_place") < room, F.col("shard"))).drop("_place")
    return at.where(F.col("shard").isNull() | ~F.col("shard").isin(over)).unionByName(cut)


def sharded(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Law ``rows``: the counts of the shards are at most one apart. Equal texts
    go to one shard as far as its quota allows; a larger group takes up
    several. A null text has size 1 and checksum 0. Repeated rows count one by
    one; where rows go doesn't depend on how the input is dealt out, but that
    rows with equal doc_id and text may change places. Slots are gapless from 0 in each shard; an empty table gives none.
    """
    body = F.col(text)
    # The key tells rows apart; the rows are written once, so it stays as it is. What orders them is the spot.
    rows = docs.select("doc_id", (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("bigint").alias("size"), F.coalesce(F.crc32(body.cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"), *_group(body), F.monotonically_increasing_id().alias("key"))
    rows = written(rows.withColumn("spot", F.xxhash64("doc_id", *GROUP)), "rows")
    n = rows.count()
    sizes = rows.groupBy(*GROUP).agg(F.count("*").alias("members")).where("members > 1")
    linked = join_hot(rows.select("key", "spot", *GROUP), written(sizes, "groups"), GROUP, "members", n)
    placed = written(propagate(linked, n // shards, shards).where("shard IS NOT NULL").select("key", "spot", "shard"), "placed")
    placed = written(running(placed, ["shard"], ["spot"], F.lit(1), "slot", ("key",)), "placed")
    load = {r.shard: r.n for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    rest = running(rows.join(placed.select("key"), "key", "left_anti").select("key", "spot"), [], ["spot"], F.lit(1), "_place", ("key",))
    # The remaining rows, in hash order, fill one shard after the other.
    shard, slot, before = F.lit(None).cast("int"), F.lit(None).cast("bigint"), 0
    for s in range(shards):
        free = quota[s] - load.get(s, 0)
        mine = (F.col("_place") >= before) & (F.col("_place") < before + free)
        shard = F.when(mine, F.lit(s)).otherwise(shard)
        slot = F.when(mine, F.col("_place") - before + load.get(s, 0)).otherwise(slot)
        before += free
    filled = rest.select("key", shard.alias("shard"), slot.cast("bigint").alias("slot"))
    where = placed.select("key", "shard", "slot").unionByName(filled)
    out = rows.join(where, "key")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))
