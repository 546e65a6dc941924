"""The n most similar rows of every query row at once, exactly.

Rows are dealt into cells by their nearest pivot, and a cell's rows, in the
order of their distance to it, into blocks of bounded size that each cover a
ring around the pivot. By the triangle inequality a row in a ring is no nearer
to a query than the ring is to the query's own distance from that pivot. A
query first searches the ring of its own cell that it lies in, which bounds
the distance of its n-th neighbour; then it meets only the rings that reach
within that bound, in any cell. Pivots are few; all else is joined by cell
and block, and queries that meet in one block are cut into chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.lookalike import FARTHEST
from tessella.sources.scratch import written

PIVOTS, BLOCK, CHUNK = 64, 4_096, 4_096
#: Decimals of the similarity by which neighbours are ordered; rows that agree in them are ordered by id.
DECIMALS = 9
_SLACK = 1e-7


def _vector(features: Column, metric: str, spare: int) -> Column:
    """The vector in which Euclid's distance orders as the metric does.

    For the cosine, vectors are scaled to length one; two more places keep a
    vector of length zero at similarity 0 from everything: a query's is in the
    first of them, a row's in the second.
    """
    v = F.transform(features, lambda x: x.cast("double"))
    if metric != "cosine":
        return v
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    zero = F.concat(F.transform(v, lambda x: F.lit(0.0)), F.array(*[F.lit(float(i == spare)) for i in range(2)]))
    return F.when(norm > 0, F.concat(F.transform(v, lambda x: x / norm), F.array(F.lit(0.0), F.lit(0.0)))).otherwise(zero)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1) if len(values) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _to_pivots(df: DataFrame, pivots: np.ndarray, whole: bool) -> DataFrame:
    """Adds ``cell`` and ``r``, the nearest pivot and the distance to it; with ``whole`` also ``to``, the distances to all."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_matrix(batch.column("v")), pivots)
                cell = d.argmin(1)
                arrays = [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])]
                if whole:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * len(pivots)), pa.array(d.ravel())))
                yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "cell", "r", *["to"] * whole])

    return df.mapInArrow(run, f"id bigint, v array<double>, cell int, r double{', to array<double>' * whole}")


def _best(n: int):
    """Of each query of a block's chunk, the n nearest rows of the block, and those that tie with the last up to rounding."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        made = {"query_id": [np.zeros(0, np.int64)], "id": [np.zeros(0, np.int64)], "d": [np.zeros(0)]}
        if queries.num_rows and rows.num_rows:
            q, ids = queries.column("id").to_numpy(), rows.column("id").to_numpy()
            left, right = _matrix(queries.column("v")), _matrix(rows.column("v"))
            for at in range(0, len(q), 512):
                d = _distances(left[at : at + 512], right)
                d[q[at : at + 512, None] == ids[None, :]] = np.inf
                last = np.partition(d, min(n, d.shape[1]) - 1, axis=1)[:, min(n, d.shape[1]) - 1]
                i, j = np.nonzero((d <= last[:, None] + _SLACK) & np.isfinite(d))
                made["query_id"].append(q[at + i])
                made["id"].append(ids[j])
                made["d"].append(d[i, j])
        return pa.table({k: np.concatenate(v) for k, v in made.items()})

    return run


_FOUND = "query_id bigint, id bigint, d double"


def _search(pairs: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """Nearest rows of queries in the blocks that they are paired with."""
    meet = pairs.select(F.col("block").alias("_block"), F.col("chunk").alias("_chunk")).distinct()
    met = rows.join(meet, F.col("block") == F.col("_block")).select("id", "v", "_block", "_chunk")
    return pairs.select("id", "v", "block", "chunk").groupBy("block", "chunk").cogroup(met.groupBy("_block", "_chunk")).applyInArrow(_best(n), _FOUND)


def top_n(queries: DataFrame, rows: DataFrame, n: int, metric: str = "cosine", pivots: int = PIVOTS, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, id, similarity and place (from 1) of the n rows most similar to each query, the query's own id left out.

    ``queries`` and ``rows`` have id (unique) and features. Neighbours are
    ordered by the similarity to 9 decimals, then by id. Rows and queries
    without an id or a vector, or with a vector of another length than most
    pivots', have no neighbours and are none. With fewer than n other rows, all come.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric}")
    usable = lambda df: df.where(F.col("id").isNotNull() & F.coalesce(F.size("features") > 0, F.lit(False)) & ~F.coalesce(F.exists("features", lambda x: x.isNull()), F.lit(False)))
    given = usable(rows).select(F.col("id").cast("bigint").alias("id"), _vector(F.col("features"), metric, 1).alias("v"))
    asked = usable(queries).select(F.col("id").cast("bigint").alias("id"), _vector(F.col("features"), metric, 0).alias("v"))
    picked = [r.v for r in given.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()]
    spark = rows.sparkSession
    if not picked:
        return spark.createDataFrame([], "query_id bigint, id bigint, similarity double, place int")
    size = max({len(v) for v in picked}, key=[len(v) for v in picked].count)
    centres = np.array([v for v in picked if len(v) == size])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = _to_pivots(given.where(F.size("v") == size), centres, False)
    dealt = written(placed.repartitionByRange(parts, "cell", "r", "id").withColumn("_part", F.spark_partition_id()), "cells")
    inside = Window.partitionBy("_part", "cell").orderBy("r", "id")
    dealt = dealt.withColumn("block", F.xxhash64("_part", "cell", F.floor((F.row_number().over(inside) - 1) / block))).drop("_part")
    dealt = written(dealt, "blocks")
    rings = written(dealt.groupBy("block", "cell").agg(F.min("r").alias("low"), F.max("r").alias("high")), "rings")
    sought = _to_pivots(asked.where(F.size("v") == size), centres, True)
    sought = written(sought, "queries")
    chunks = max(1, -(-sought.count() // chunk))
    sought = sought.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))

    away = lambda d: F.greatest(F.col("low") - d, d - F.col("high"), F.lit(0.0))
    home = sought.join(rings, "cell").groupBy("id").agg(F.min_by("block", F.struct(away(F.col("r")), F.col("block"))).alias("block"))
    first = _search(sought.select("id", "v", "chunk").join(home, "id"), dealt, n)
    bound = first.groupBy("query_id").agg(F.sort_array(F.collect_list("d")).alias("_d")).select(F.col("query_id").alias("id"), F.when(F.size("_d") >= n, F.get("_d", F.lit(n - 1))).alias("bound"))
    each = sought.join(bound, "id", "left").select("id", "v", "chunk", "bound", F.posexplode("to").alias("cell", "d"))
    near = each.join(rings, "cell").where(F.col("bound").isNull() | (away(F.col("d")) <= F.col("bound") + _SLACK))
    found = _search(near.select("id", "v", "block", "chunk"), dealt, n)

    likeness = 1.0 - F.col("d") * F.col("d") / 2.0 if metric == "cosine" else 1.0 - F.least(F.col("d") / FARTHEST["euclidean"], F.lit(1.0))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    ranked = found.select("query_id", "id", F.round(likeness, DECIMALS).alias("similarity")).withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= n)
