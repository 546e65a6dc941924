"""Connected components by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.scratch import forget, written


def _hooked(links: DataFrame) -> DataFrame:
    """Every end of ``links`` (a, b, both ways round) and the smallest of it and its neighbours, as (a, low)."""
    return links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` for every end of ``edges`` (a, b): root is the smallest node that is reachable.

    Two steps take turns until nothing changes. In the large step every node
    ties its larger neighbours to the smallest node it knows; in the small
    step it ties itself and its smaller neighbours to that. Components keep
    together, the number of edges never grows, and long paths shrink by a
    factor each round, so that the number of rounds follows the logarithm of
    the longest path. Edges are written to the shared folder each round and
    those of the round before deleted; nothing but a count comes to the
    driver. Null ends and loops are no edges.
    """
    now = written(edges.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").where("a > b").distinct(), "edges")
    ends = written(now.select("a").union(now.select("b")).distinct(), "ends")
    for _ in range(most_rounds):
        both = now.unionByName(now.selectExpr("b AS a", "a AS b"))
        large = both.join(_hooked(both), "a").where("b > a").selectExpr("b AS a", "low AS b").distinct()
        large = written(large, "edges")
        # Every edge now points from the larger end to the smaller.
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b <> low").selectExpr("b AS a", "low AS b").unionByName(low.withColumnRenamed("low", "b")).distinct()
        after = written(small, "edges")
        sign = [F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("all"), F.expr("sum(cast(xxhash64(b, a) as decimal(38, 0)))").alias("sum")]
        settled = now.agg(*sign).first() == after.agg(*sign).first()
        forget(now)
        forget(large)
        now = after
        if settled:
            roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
            found = written(ends.withColumnRenamed("a", "node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "labels")
            forget(now)
            forget(ends)
            return found
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def forest(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root, depth, total and cyclic for every row of ``links`` (node, parent, value).

    ``total`` is the value of the node and of all below it. A node without a
    parent is a root; so is a parent that has no row, which then is the root
    of its children, at depth 1. Nodes whose links lead into a circle are
    cyclic and have neither root, depth nor total. Nodes are unique and not null.

    Pointers double: after k rounds a node knows its ancestor 2^k steps up, or
    its root, and the sum over all less than 2^k steps below. Every round
    ends some node of a tree, so when a round ends none, what is left is
    cyclic; rounds follow the logarithm of the depth. Each is a written table.
    """
    known = links.select(F.col("node").alias("_known"))
    given = links.join(known, F.col("parent") == F.col("_known"), "left")
    first = given.select(
        "node",
        F.coalesce("parent", "node").alias("up"),
        F.col("parent").isNotNull().cast("bigint").alias("hops"),
        (F.col("parent").isNull() | F.col("_known").isNull()).alias("ended"),
        F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("total"),
    )
    now, left = written(first, "forest"), None
    for k in range(most_rounds):
        step = 1 << k
        below = now.where(F.col("hops") == step).groupBy(F.col("up").alias("_above")).agg(F.sum("total").alias("_more"))
        summed = now.join(below, F.col("node") == F.col("_above"), "left").withColumn("total", F.col("total") + F.coalesce("_more", F.lit(0.0))).drop("_above", "_more")
        ahead = now.select(F.col("node").alias("_at"), F.col("up").alias("_up"), F.col("hops").alias("_hops"), F.col("ended").alias("_ended"))
        moved = summed.where("NOT ended").join(ahead, F.col("up") == F.col("_at")).select("node", F.col("_up").alias("up"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_ended").alias("ended"), "total")
        after = written(summed.where("ended").unionByName(moved), "forest")
        forget(now)
        now, before, left = after, left, after.where("NOT ended").count()
        # Sums reach a round further than pointers, so the round that ends the last node is followed by one more.
        if left == before:
            keep = lambda c: F.when(F.col("ended"), F.col(c))
            return now.select("node", keep("up").alias("root"), keep("hops").alias("depth"), keep("total").alias("total"), (~F.col("ended")).alias("cyclic"))
    raise RuntimeError(f"links did not settle in {most_rounds} rounds")
