"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that one task numbers at once, and chunks of a group; very large groups have larger chunks.
ROWS_PER_CHUNK, MOST_CHUNKS = 1_000, 65_536


def slices(batches: Iterable[pa.RecordBatch], text: str, at_most: int = 4 << 20, rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each piece hold few bytes, but for single long ones."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        total, start = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and (total + n > at_most or i - start >= rows):
                yield batch.slice(start, i - start)
                total, start = 0, i
            total += n
        yield batch.slice(start)


def packed_rows(df: DataFrame) -> DataFrame:
    """The rows as one struct column ``_row``, so that no helper column can clash with theirs."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def row_key(text: str = "text") -> list[Column]:
    """What tells packed rows apart without null: ``_id`` from doc_id, ``_hash`` from the text."""
    return [F.coalesce(F.col("_row.doc_id"), F.lit(-(2**63))).alias("_id"), F.xxhash64(f"_row.{text}").alias("_hash")]


def running(df: DataFrame, group: list[str], order: list[str], value: Column, out: str, tie: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the group that come before.

    Within a group, rows are in the order of a hash of ``order``, then of
    ``order`` itself. A hot group is cut into chunks of about ROWS_PER_CHUNK
    rows by that hash; the offsets are one row per chunk. Rows that agree in
    all of ``order`` are in the order of ``tie``, or may swap places. Groups and order columns may be null.
    """
    hashed = F.xxhash64(*[F.col(c) for c in order])
    chunks = F.least(F.ceil(F.count("*") / ROWS_PER_CHUNK), F.lit(MOST_CHUNKS)).alias("_chunks")
    sizes = df.groupBy(*group).agg(chunks) if group else df.agg(chunks)
    cut = _null_safe(df, sizes, group) if group else df.crossJoin(F.broadcast(sizes))  # one row
    cut = cut.withColumn("_h", hashed).withColumn("_v", value.cast("bigint")).withColumn("_chunk", F.pmod("_h", F.greatest("_chunks", F.lit(1)))).drop("_chunks")
    per = cut.groupBy(*group, "_chunk").agg(F.sum("_v").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*group, "_chunk").orderBy("_h", *order, *tie).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("_local", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    joined = _null_safe(local, per, [*group, "_chunk"])
    return joined.withColumn(out, (F.col("_base") + F.col("_local")).cast("bigint")).drop("_h", "_v", "_chunk", "_base", "_local")


def _null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join on columns that may be null; the right side's copies of them go."""
    names = {c: f"_right_{c}" for c in on}
    right = right.withColumnsRenamed(names)
    condition = None
    for c in on:
        same = left[c].eqNullSafe(right[names[c]])
        condition = same if condition is None else condition & same
    return left.join(right, condition, how).drop(*names.values())


null_safe_join = _null_safe


#: A key with more than one row in so many of all is hot; there are at most as many hot keys.
HOT_SHARE = 1_000


def join_hot(rows: DataFrame, side: DataFrame, on: list[str], members: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``side``, which has one row per key and, in ``members``, how many rows the key has.

    The side's rows of hot keys are HOT_SHARE at most; they are broadcast, so
    the rows of a hot key stay where they are. All others meet by a shuffle,
    in which no key has more than one row in HOT_SHARE. Keys aren't null.
    """
    hot = F.col(members) > total / HOT_SHARE
    few = F.broadcast(side.where(hot).drop(members))
    rest = rows.join(F.broadcast(side.where(hot).select(*on)), on, "left_anti")
    return rows.join(few, on).unionByName(rest.join(side.where(~hot).drop(members), on))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0]+1, ... for each run of the given lengths."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - (ends - lengths), lengths)
