"""Lookalike audiences: similarity to seeds, thresholds and nearest customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import dot
from tessella.functions.ranges import cumulative

FARTHEST = {"euclidean": 100.0, "manhattan": 200.0}


def similarity(a: Column, b: Column, metric: str) -> Column:
    """Cosine, or one less the distance over the farthest that counts; 0 for vectors of unlike length."""
    if metric == "cosine":
        norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
        value = F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)
    elif metric in FARTHEST:
        gap = lambda x, y: x.cast("double") - y.cast("double")
        step = (lambda x, y: gap(x, y) * gap(x, y)) if metric == "euclidean" else (lambda x, y: F.abs(gap(x, y)))
        total = F.aggregate(F.zip_with(a, b, step), F.lit(0.0), lambda s, v: s + v)
        value = 1.0 - F.least((F.sqrt(total) if metric == "euclidean" else total) / FARTHEST[metric], F.lit(1.0))
    else:
        raise ValueError(f"unknown metric {metric}")
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), value).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Equal entries of two maps over all their entries; 0 where one is empty."""
    x, y = F.map_entries(a), F.map_entries(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def centroid(seeds: DataFrame, features: str = "features") -> DataFrame:
    """Mean vector of the seeds: one row, ``centroid``."""
    per = seeds.select(F.posexplode(features)).groupBy("pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    return per.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def usual_categories(seeds: DataFrame, column: str) -> DataFrame:
    """Commonest value of each key of a map column; of equals the first by value."""
    per = seeds.select(F.explode(column)).groupBy("key", "value").agg(F.count("*").alias("n"))
    return per.groupBy("key").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))


def scored(candidates: DataFrame, seeds: DataFrame, metric: str) -> DataFrame:
    """Candidates with their similarity to the seeds' centroid, which is one row."""
    return candidates.crossJoin(F.broadcast(centroid(seeds))).withColumn("similarity_score", similarity(F.col("features"), F.col("centroid"), metric)).drop("centroid")


def audience(candidates: DataFrame, seeds: DataFrame, metric: str, percentile: float = 0.9, most: int | None = None) -> DataFrame:
    """Candidates at or above the similarity that the given share of them lies below.

    The threshold is the value at place ⌊(1-p)·n⌋ in descending order; values
    that tie with it are all taken. It is found from counts of distinct
    values, so no task orders all candidates.
    """
    rows = scored(candidates, seeds, metric).withColumn("similarity_score", F.round("similarity_score", 12))
    counts = rows.groupBy("similarity_score").agg(F.count("*").alias("n"))
    ranked = cumulative(counts, [], [F.desc("similarity_score")], {"_upto": "n"})
    ranked = ranked.crossJoin(F.broadcast(ranked.agg(F.max("_upto").alias("_all"))))  # one row
    place = F.floor(F.lit(1.0 - percentile) * F.col("_all") + 1e-9)
    limit = ranked.where(F.col("_upto") > place).agg(F.coalesce(F.max("similarity_score"), F.lit(0.0)).alias("_limit"))
    out = rows.crossJoin(F.broadcast(limit)).where((F.col("similarity_score") > 0) & (F.col("similarity_score") >= F.col("_limit"))).drop("_limit")  # one row
    return out.orderBy(F.desc("similarity_score"), "customer_id").limit(most) if most else out


def summary(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """Counts, ends and mean of the similarity, and the predicted lifetime value."""
    worth = seeds.agg(F.avg("ltv").alias("_ltv"), F.count("*").alias("seed_count"))
    s = F.col("similarity_score")
    out = found.agg(F.count("*").alias("lookalike_count"), F.min(s).alias("min_similarity"), F.max(s).alias("max_similarity"), F.avg(s).alias("avg_similarity"))
    return out.crossJoin(F.broadcast(worth)).withColumn("predicted_ltv", F.col("avg_similarity") * F.col("_ltv")).drop("_ltv")  # one row each


def nearest(candidates: DataFrame, seed: DataFrame, n: int, metric: str) -> DataFrame:
    """The n candidates most like one seed, with their percentile."""
    one = seed.select(F.col("features").alias("_seed")).limit(1)
    total = candidates.agg(F.count("*").alias("_total"))
    rows = candidates.crossJoin(F.broadcast(one)).withColumn("similarity_score", similarity(F.col("features"), F.col("_seed"), metric)).drop("_seed")
    top = rows.orderBy(F.desc("similarity_score"), "customer_id").limit(n)
    placed = top.withColumn("_i", F.row_number().over(Window.orderBy(F.desc("similarity_score"), "customer_id")) - 1)
    return placed.crossJoin(F.broadcast(total)).withColumn("percentile", F.col("_i") * 100.0 / F.col("_total")).drop("_i", "_total")
