"""Clustering by loops of aggregations, cluster quality, and choice of k.

Points are (id, features array<double>). A round is one pass over the points
with the centres as literals of the plan: distances are scalar expressions, so
the pass is one generated loop with a partial aggregation behind it, and what
comes to the driver is one row per cluster.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.checks import finite
from tessella.functions.columns import dot
from tessella.functions.draws import uniform
from tessella.operators.graph import connected_components
from tessella.sources.scratch import written

#: Numbers that a block of the exact silhouette, which compares all pairs, holds, and pairs of blocks that a task takes.
PAIRED_NUMBERS, PAIRED_A_TASK = 65_536, 200
#: Distances that are laid out at once for it.
LAID_OUT = 400_000
#: Pairs of points of two boxes that are compared one by one, and how often larger boxes are halved before.
COMPARED, MOST_HALVED = 10_000, 30
#: Axes up to which distances are spelled out as one generated sum.
SPELLED = 16
#: Axes up to which cells meet by neighbouring blocks; with more, by a tree of boxes whose leaves hold about LEAF cells and that is read LEVELS at a time.
BLOCK_AXES, LEAF, LEVELS = 3, 64, 3
#: Points a cell, on average, under which points of many axes are compared without cells, leaf by leaf; most points and numbers of a leaf, and points that are laid against a leaf at once.
FEW_A_CELL, LEAF_POINTS, LEAF_NUMBERS, AT_ONCE = 2, 8_192, 1 << 20, 256


def _width(points: DataFrame) -> int:
    row = points.select(F.min(F.size("features")).alias("a"), F.max(F.size("features")).alias("b")).first()
    if row.a is None:
        raise ValueError("there are no points")
    if row.a != row.b:
        raise ValueError("features differ in length")
    return row.a


def _cells(width: int) -> list[Column]:
    return [F.col("features")[i].cast("double") for i in range(width)]


def distance(cells: list[Column], centre: list[float], metric: str = "squared") -> Column:
    """Distance of a row's cells from a literal centre."""
    gaps = [c - F.lit(float(v)) for c, v in zip(cells, centre, strict=True)]
    if metric == "manhattan":
        return sum((F.abs(g) for g in gaps[1:]), F.abs(gaps[0]))
    if metric == "cosine":
        own = F.sqrt(sum((c * c for c in cells[1:]), cells[0] * cells[0]))
        norm = math.sqrt(sum(v * v for v in centre))
        inner = sum((c * F.lit(float(v)) for c, v in zip(cells[1:], centre[1:], strict=True)), cells[0] * F.lit(float(centre[0])))
        return F.when((own > 0) & F.lit(norm > 0), 1.0 - inner / F.when(own > 0, own) / (norm or 1.0)).otherwise(0.0)
    square = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])
    return F.sqrt(square) if metric == "euclidean" else square


def nearest(cells: list[Column], centres: list[list[float]], metric: str = "squared") -> tuple[Column, Column]:
    """Number of the nearest centre, the first of equals, and its distance."""
    all_ = F.array(*[distance(cells, c, metric) for c in centres])
    return F.array_position(all_, F.array_min(all_)).cast("int") - 1, F.array_min(all_)


@dataclass
class Model:
    centres: list[list[float]]
    inertia: float
    iterations: int
    metric: str = "squared"
    history: list[float] = field(default_factory=list)

    def transform(self, points: DataFrame) -> DataFrame:
        """Adds ``cluster`` and, unless the points have one, nothing else."""
        if not self.centres:
            raise ValueError("the model has no centres")
        return points.withColumn("cluster", nearest(_cells(len(self.centres[0])), self.centres, self.metric)[0])


def spread_centres(points: DataFrame, k: int, seed: int) -> list[list[float]]:
    """k-means++ seeding: each further centre with a chance that grows with the squared distance from those there are.

    A weighted draw is the largest of ln(u)/w over the rows, u drawn by the
    row's id, so it is one aggregation.
    """
    width = _width(points)
    cells = _cells(width)
    centres: list[list[float]] = []
    for i in range(k):
        u = uniform(F.col("id"), seed, i)
        weight = nearest(cells, centres)[1] if centres else F.lit(1.0)
        found = points.agg(F.max_by("features", F.when(weight > 0, F.ln(u) / weight)).alias("c")).first().c
        if found is None:  # all points lie on centres
            found = points.agg(F.max_by("features", F.xxhash64("id", F.lit(seed + i))).alias("c")).first().c
        centres.append([float(v) for v in found])
    return centres


def strided_centres(points: DataFrame, k: int) -> list[list[float]]:
    """The points at places i * (n // k) in order of id."""
    n = points.count()
    if not 0 < k <= n:
        raise ValueError(f"k is {k} for {n} points")
    return _at(points, [i * (n // k) for i in range(k)])


def _at(points: DataFrame, places: list[int]) -> list[list[float]]:
    from tessella.operators.rfm import positions

    rows = positions(points.select("id", "features"), [F.col("id").asc()], "_i").where(F.col("_i").isin(places)).collect()
    by = {r["_i"]: [float(v) for v in r.features] for r in rows}
    return [by[p] for p in places]


def lloyd(points: DataFrame, centres: list[list[float]], max_iter: int = 300, metric: str = "squared", tolerance: float | None = None) -> Model:
    """Rounds of assignment and means.

    Without ``tolerance`` it ends where the centres stay as they are, and an
    empty cluster takes the point farthest from its own centre. With one it
    ends where the inertia of the new centres changes by less, and an empty
    cluster i takes the point at place 7i mod n in order of id.
    """
    points = written(points.select("id", "features"), "points")  # each round reads it
    width = _width(points)
    cells = _cells(width)
    last, inertia, history = None, math.inf, []
    for done in range(1, max_iter + 1):
        cluster, gap = nearest(cells, centres, metric)
        sums = points.select(cluster.alias("cluster"), gap.alias("gap"), *[c.alias(f"x{i}") for i, c in enumerate(cells)])
        rows = {r.cluster: r for r in sums.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("gap").alias("gap"), *[F.avg(f"x{i}").alias(f"x{i}") for i in range(width)]).collect()}
        new = [[rows[j][f"x{i}"] for i in range(width)] if j in rows else None for j in range(len(centres))]
        empty = [j for j, c in enumerate(new) if c is None]
        if empty and tolerance is None:
            for j, r in zip(empty, points.orderBy(gap.desc(), "id").limit(len(empty)).collect(), strict=False):  # the farthest, one for each
                new[j] = [float(v) for v in r.features]
            new = [c if c is not None else centres[j] for j, c in enumerate(new)]
        elif empty:
            n = sum(r.n for r in rows.values())
            for j, c in zip(empty, _at(points, [7 * j % n for j in empty]), strict=True):
                new[j] = c
        if tolerance is None:
            inertia = sum(r.gap for r in rows.values())
            history.append(inertia)
            if new == centres:
                return Model(centres, inertia, done, metric, history)
            centres = new
            continue
        per = F.lit(0.0)
        for j, c in enumerate(new):
            per = F.when(cluster == j, distance(cells, c, "euclidean" if metric == "squared" else metric)).otherwise(per)
        last, inertia = inertia, points.agg(F.sum(F.pow(per, 2.0)).alias("i")).first().i
        history.append(inertia)
        centres = new
        if abs(last - inertia) < tolerance:
            return Model(centres, inertia, done, metric, history)
    return Model(centres, inertia, max_iter, metric, history)


def fit_kmeans(points: DataFrame, k: int, seed: int = 42, max_iter: int = 300) -> Model:
    """k-means with k-means++ seeding. Points without ``id`` are told apart by their features."""
    rows = points if "id" in points.columns else points.withColumn("id", F.xxhash64("features"))
    rows = written(rows.select("id", finite(F.col("features")).alias("features")), "points")
    if not 0 < k <= rows.count():
        raise ValueError(f"k is {k} for {rows.count()} points")
    return lloyd(rows, spread_centres(rows, k, seed), max_iter)


def fit_strided(points: DataFrame, k: int, max_iter: int = 100, metric: str = "euclidean") -> Model:
    """The deterministic variant behind the choice of k: strided start, end by inertia."""
    return lloyd(points, strided_centres(points, k), max_iter, metric, tolerance=1e-6)


# Mixed points: numbers and categories.


def prototype_gamma(points: DataFrame) -> float:
    """Weight of a category's mismatch: root of the mean variance of the numbers."""
    width = _width(points)
    row = points.agg(*[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(_cells(width))]).first()
    return max(math.sqrt(sum(row) / width), 1e-9)


def mixed_distance(cells: list[Column], kinds: list[Column], centre: list[float], modes: list[int], gamma: float) -> Column:
    misses = [(k != F.lit(m)).cast("int") for k, m in zip(kinds, modes, strict=True)]
    return distance(cells, centre) + F.lit(gamma) * sum(misses[1:], misses[0])


def assign_prototypes(points: DataFrame, centres: list[list[float]], modes: list[list[int]], gamma: float) -> DataFrame:
    cells, kinds = _cells(len(centres[0])), [F.col("categories")[i] for i in range(len(modes[0]))]
    all_ = F.array(*[mixed_distance(cells, kinds, c, m, gamma) for c, m in zip(centres, modes, strict=True)])
    return points.withColumn("cluster", F.array_position(all_, F.array_min(all_)).cast("int") - 1)


def fit_prototypes(points: DataFrame, k: int, seed: int = 42, max_iter: int = 300) -> tuple[list[list[float]], list[list[int]], float]:
    """k-prototypes of (id, features, categories): means, modes (the largest of equals) and the weight."""
    points = written(points.withColumn("features", finite(F.col("features"))), "points")
    width, n_kinds = _width(points), points.select(F.size("categories").alias("n")).first().n
    gamma = prototype_gamma(points)
    centres = spread_centres(points, k, seed)
    cells = _cells(width)
    cluster, _ = nearest(cells, centres)
    seeds = points.groupBy(cluster.alias("cluster")).agg(F.min_by("categories", nearest(cells, centres)[1]).alias("c")).collect()
    modes = {r.cluster: list(r.c) for r in seeds}
    modes = [modes.get(j, [0] * n_kinds) for j in range(k)]
    for _ in range(max_iter):
        at = assign_prototypes(points, centres, modes, gamma)
        means = {r.cluster: [r[f"x{i}"] for i in range(width)] for r in at.groupBy("cluster").agg(*[F.avg(c).alias(f"x{i}") for i, c in enumerate(cells)]).collect()}
        counted = at.select("cluster", F.posexplode("categories")).groupBy("cluster", "pos", "col").agg(F.count("*").alias("n"))
        best = {(r.cluster, r.pos): r.mode for r in counted.groupBy("cluster", "pos").agg(F.max_by("col", F.struct("n", "col")).alias("mode")).collect()}
        new = [means.get(j, centres[j]) for j in range(k)]
        new_modes = [[best.get((j, i), modes[j][i]) for i in range(n_kinds)] for j in range(k)]
        if (new, new_modes) == (centres, modes):
            break
        centres, modes = new, new_modes
    return centres, modes, gamma


class MiniBatch:
    """Centres that follow batches of points by running means.

    The first batch of k points or more seeds the centres only. Later batches
    are assigned to the centres as they stand, and each centre becomes the
    mean of all points it has been given; the points of one batch have no
    order among them.
    """

    def __init__(self, k: int, seed: int = 42):
        if k < 1:
            raise ValueError("k must be positive")
        self.k, self.seed = k, seed
        self.centres: list[list[float]] = []
        self.counts = [0] * k

    def partial_fit(self, points: DataFrame) -> MiniBatch:
        n = points.count()
        if not self.centres:
            if n >= self.k:
                rows = points if "id" in points.columns else points.withColumn("id", F.xxhash64("features"))
                self.centres = spread_centres(rows, self.k, self.seed)
            return self
        if n:
            width = len(self.centres[0])
            cells = _cells(width)
            rows = points.groupBy(nearest(cells, self.centres)[0].alias("cluster")).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"x{i}") for i, c in enumerate(cells)]).collect()
            for r in rows:
                total = self.counts[r.cluster] + r.n
                self.centres[r.cluster] = [(c * self.counts[r.cluster] + r[f"x{i}"]) / total for i, c in enumerate(self.centres[r.cluster])]
                self.counts[r.cluster] = total
        return self

    def predict(self, points: DataFrame) -> DataFrame:
        return Model(self.centres, 0.0, 0).transform(points)


# Density, agglomeration, soft assignment.


def _sum_squares(gaps: list[Column]) -> Column:
    return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])


def _folded(gaps: Column) -> Column:
    """Root of the sum of squares of an array, for vectors too wide to spell out."""
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap * gap))


def _apart(a: str, b: str, width: int) -> Column:
    if width > SPELLED:
        return _folded(F.zip_with(a, b, lambda x, y: x - y))
    return F.sqrt(_sum_squares([F.col(a)[i] - F.col(b)[i] for i in range(width)]))


def _boxes(points: DataFrame, by: list[str], width: int) -> DataFrame:
    """Of each group: its points, corners of the box around them, and its smallest id."""
    cells = _cells(width)
    return points.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.min(c) for c in cells]).alias("lo"), F.array(*[F.max(c) for c in cells]).alias("hi"), F.min("id").alias("node"))


def _nearest_gap(width: int) -> Column:
    if width > SPELLED:
        above, below = F.zip_with("lo2", "hi", lambda x, y: x - y), F.zip_with("lo", "hi2", lambda x, y: x - y)
        return _folded(F.zip_with(above, below, lambda x, y: F.greatest(x, y, F.lit(0.0))))
    return F.sqrt(_sum_squares([F.greatest(F.col("lo2")[i] - F.col("hi")[i], F.col("lo")[i] - F.col("hi2")[i], F.lit(0.0)) for i in range(width)]))


def _farthest_gap(width: int) -> Column:
    if width > SPELLED:
        return _folded(F.zip_with(F.zip_with("hi2", "lo", lambda x, y: x - y), F.zip_with("hi", "lo2", lambda x, y: x - y), lambda x, y: F.greatest(x, y)))
    return F.sqrt(_sum_squares([F.greatest(F.col("hi2")[i] - F.col("lo")[i], F.col("hi")[i] - F.col("lo2")[i]) for i in range(width)]))


def _renamed(boxes: DataFrame) -> DataFrame:
    return boxes.withColumnsRenamed({c: f"{c}2" for c in boxes.columns})


def _touching(boxes: DataFrame, width: int, eps: float) -> DataFrame:
    """Pairs of different cells with points that may be within eps; ``far`` says that all of them are."""
    met = (_by_blocks if width <= BLOCK_AXES else _by_tree)(boxes, width, eps).where(F.col("cell") != F.col("cell2"))
    return met.where(_nearest_gap(width) <= eps).withColumn("far", _farthest_gap(width) <= eps)


def _by_blocks(boxes: DataFrame, width: int, eps: float) -> DataFrame:
    """Cells meet by blocks wider than eps, each with the 3^width neighbouring blocks; a block holds a bounded number of cells."""
    block = math.isqrt(width) + 1
    own = boxes.withColumn("_at", F.transform("cell", lambda v: F.floor(v / block).cast("bigint")))
    around = F.array(F.array().cast("array<bigint>"))
    for _ in range(width):
        around = F.flatten(F.transform(around, lambda p: F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.array_append(p, d.cast("bigint")))))
    spread = own.withColumn("_d", F.explode(around)).withColumn("_at", F.zip_with("_at", "_d", lambda x, y: x + y)).drop("_d")
    return own.join(_renamed(spread).withColumnRenamed("_at2", "_at"), "_at").drop("_at")


def _by_tree(boxes: DataFrame, width: int, eps: float) -> DataFrame:
    """Cells meet where their leaves of a tree of boxes do."""
    marked, pairs = _tree(boxes, width, eps, boxes.count(), LEAF, "lo", "hi")
    both = pairs.unionByName(pairs.where("a < b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(marked.withColumnRenamed("_code", "a"), "a").join(_renamed(marked).withColumnRenamed("_code2", "b"), "b").drop("a", "b")


def _tree(boxes: DataFrame, width: int, eps: float, n: int, leaf: int, lo: str, hi: str) -> tuple[DataFrame, DataFrame]:
    """The ``n`` boxes with ``_code``, their leaf, and pairs a <= b of leaves, by a tree of boxes that is descended against itself.

    A level of the tree halves by one axis, at quantiles, the widest axes
    first; a node's box is what its cells fill. Only pairs of nodes whose
    boxes are within eps are followed, so the pairs that are held are those
    that touch, whatever the number of axes. Where the points fill many axes
    evenly, all boxes touch, and then all cells meet, leaf by leaf.
    """
    levels = max(0, math.ceil(math.log2(max(n, 1) / leaf)))
    if not levels:
        marked = boxes.withColumn("_code", F.lit(0).cast("bigint"))
    else:
        most = -(-levels // width)
        starts = boxes.select(*[F.col(lo)[i].alias(f"x{i}") for i in range(width)])
        cuts = starts.approxQuantile(starts.columns, [j / (1 << most) for j in range((1 << most) + 1)], 0.002)
        axes = sorted(range(width), key=lambda i: (cuts[i][0] - cuts[i][-1], i))
        place = [F.lit(0)] * width
        for i in range(width):
            inner = cuts[i][1:-1]
            place[i] = sum((F.when(F.col(lo)[i] >= c, 1).otherwise(0) for c in inner[1:]), F.when(F.col(lo)[i] >= inner[0], 1).otherwise(0))
        code = F.lit(0).cast("bigint")
        for t in range(levels):
            bit = F.shiftright(place[axes[t % width]], most - 1 - t // width).bitwiseAND(F.lit(1))
            code = code * 2 + bit
        marked = written(boxes.withColumn("_code", code.cast("bigint")), "marked")
    pairs = boxes.sparkSession.createDataFrame([(0, 0)], "a bigint, b bigint")
    at = 0
    while at < levels:
        below = min(at + LEVELS, levels)
        node = F.shiftright("_code", levels - below)
        sides = [F.array(*[f(F.col(c)[i]) for i in range(width)]).alias(side) for side, c, f in (("lo", lo, F.min), ("hi", hi, F.max))]
        nodes = written(marked.groupBy(node.alias("node")).agg(*sides).withColumn("_in", F.shiftright("node", below - at)), "nodes")
        met = pairs.join(nodes.withColumnRenamed("_in", "a"), "a").join(_renamed(nodes).withColumnRenamed("_in2", "b"), "b")
        pairs = written(met.where("node <= node2").where(_nearest_gap(width) <= eps).select(F.col("node").alias("a"), F.col("node2").alias("b")), "pairs")
        at = below
    return marked, pairs


@dataclass
class _Density:
    points: DataFrame  # id, features, cell
    touching: DataFrame  # pairs of cells
    rare: DataFrame  # points of cells whose counts alone don't make them core points
    core: DataFrame  # id, features, cell
    width: int
    side: float


def _in_cells(points: DataFrame, eps: float) -> tuple[DataFrame, int, float]:
    """The points with their cells, the number of axes and a cell's side: so small that all points of a cell are within eps."""
    if not eps > 0:
        raise ValueError("eps must be positive")
    width = _width(points)
    side = eps / math.sqrt(width) * (1 - 1e-12)
    return written(points.select("id", finite(F.col("features")).alias("features"), F.array(*[F.floor(c / side).cast("bigint") for c in _cells(width)]).alias("cell")), "points"), width, side


def _scattered(rows: DataFrame, width: int) -> bool:
    """Whether cells are of no help: there are many axes, and hardly two points in a cell."""
    return width > BLOCK_AXES and rows.select("cell").distinct().count() * FEW_A_CELL > rows.count()


def _density(rows: DataFrame, width: int, side: float, eps: float, least: int) -> _Density:
    """Core points by a grid whose cells are so small that all points of one are within eps.

    Where a cell and the cells that lie within eps as a whole hold ``least``
    points, all of its points are core points by counts alone. Only points of
    other cells, under ``least`` a cell, are compared with points around them,
    so the comparisons grow with the points and not with a cell's square.
    """
    boxes = written(_boxes(rows, ["cell"], width), "cells")
    touching = written(_touching(boxes, width, eps), "touching")
    whole = touching.groupBy("cell").agg(F.sum(F.when(F.col("far"), F.col("n2")).otherwise(0)).alias("_whole"))
    known = boxes.join(whole, "cell", "left").select("cell", (F.col("n") + F.coalesce("_whole", F.lit(0))).alias("known"))
    rare = written(rows.join(known.where(F.col("known") < least), "cell"), "rare")
    near = _met(rare, touching, rows.select(F.col("cell").alias("cell2"), F.col("features").alias("_other")), width, eps).groupBy("id").agg(F.count("*").alias("_near"))
    few = rare.join(near, "id", "left").where(F.col("known") + F.coalesce("_near", F.lit(0)) >= least).select("id", "features", "cell")
    many = rows.join(known.where(F.col("known") >= least), "cell").select("id", "features", "cell")
    return _Density(rows, touching, rare, written(many.unionByName(few), "core"), width, side)


def _met(rare: DataFrame, touching: DataFrame, others: DataFrame, width: int, eps: float) -> DataFrame:
    """Rows of ``rare`` with those of ``others`` (cell2, _other) within eps in cells that are only partly so."""
    asked = rare.join(touching.where(~F.col("far")).select("cell", "cell2"), "cell")
    return asked.join(others, "cell2").where(_apart("features", "_other", width) <= eps)


def core_points(points: DataFrame, eps: float, least: int) -> DataFrame:
    """``id`` of points with ``least`` points within eps, themselves included. Ids are unique."""
    rows, width, side = _in_cells(points, eps)
    if _scattered(rows, width):
        return _counted_core(*_leaves(rows, width, eps), eps, least).where("core").select("id")
    return _density(rows, width, side, eps, least).core.select("id")


def _cell_links(core: DataFrame, width: int, side: float, eps: float) -> DataFrame:
    """Pairs (a, b) of cells, by their smallest core points, with two core points within eps.

    Boxes around the points decide most pairs. Undecided boxes are halved
    along each axis until they are decided or hold few enough points to
    compare; a pair of cells is done with its first pair of points.
    """
    cells = written(_boxes(core, ["cell"], width), "cells")
    pairs = written(_touching(cells, width, eps).where("node < node2"), "pairs")
    links = pairs.where("far").select("node", "node2")
    placed = written(core.join(cells.select("cell", "node"), "cell"), "placed")
    open_ = written(pairs.where(~F.col("far")).select("node", "node2", F.col("cell").alias("sub"), F.col("cell2").alias("sub2"), "n", "n2"), "open")
    for level in range(MOST_HALVED + 1):
        at = lambda halved: F.array(*[F.floor(c / (side / 2**halved)).cast("bigint") for c in _cells(width)])
        small = open_.where(F.col("n") * F.col("n2") <= COMPARED) if level < MOST_HALVED else open_
        here = placed.select("node", at(level).alias("sub"), "features")
        there = here.select(F.col("node").alias("node2"), F.col("sub").alias("sub2"), F.col("features").alias("_other"))
        near = small.join(here, ["node", "sub"]).join(there, ["node2", "sub2"]).where(_apart("features", "_other", width) <= eps)
        found = written(near.select("node", "node2").distinct(), "found")
        links = links.unionByName(found)
        if level == MOST_HALVED:
            break
        large = written(open_.where(F.col("n") * F.col("n2") > COMPARED).join(found, ["node", "node2"], "left_anti"), "open")
        if large.isEmpty():
            break
        held = placed.join(large.select("node").union(large.select("node2")).distinct(), "node", "left_semi")
        halves = _boxes(held.withColumn("sub", at(level)).withColumn("half", at(level + 1)).withColumnRenamed("node", "_node"), ["_node", "sub", "half"], width).drop("node").withColumnRenamed("_node", "node")
        halves = written(halves, "halves")
        met = large.select("node", "node2", "sub", "sub2").join(halves, ["node", "sub"]).join(_renamed(halves), ["node2", "sub2"]).where(_nearest_gap(width) <= eps).withColumn("far", _farthest_gap(width) <= eps)
        met = written(met.select("node", "node2", F.col("half").alias("sub"), F.col("half2").alias("sub2"), "n", "n2", "far"), "met")
        whole = met.where("far").select("node", "node2").distinct()
        links = links.unionByName(whole)
        open_ = written(met.where(~F.col("far")).join(whole, ["node", "node2"], "left_anti").drop("far"), "open")
    return links.select(F.col("node").alias("a"), F.col("node2").alias("b"))


def dbscan(points: DataFrame, eps: float, least: int) -> DataFrame:
    """id, cluster: density clusters numbered from 1 in order of their smallest core point; null is noise.

    A border point goes to the cluster with the lowest number among its core
    neighbours. Core points of one cell are one node of the graph, so that a
    dense cell costs its points and not their pairs. Points of many axes that
    hardly share cells are compared leaf by leaf. Ids are unique.
    """
    from tessella.operators.rfm import positions

    rows, width, side = _in_cells(points, eps)
    if _scattered(rows, width):
        return _scattered_dbscan(rows, width, eps, least)
    made = _density(rows, width, side, eps, least)
    cells = made.core.groupBy("cell").agg(F.min("id").alias("node"))
    roots = connected_components(_cell_links(made.core, made.width, made.side, eps))
    rooted = written(cells.join(roots, "node", "left").select("cell", F.coalesce("root", "node").alias("root")), "rooted")
    numbers = positions(rooted.select("root").distinct(), [F.col("root").asc()], "_i").select("root", (F.col("_i") + 1).cast("int").alias("cluster"))
    clusters = written(rooted.join(numbers, "root").select("cell", "cluster"), "clusters")
    inner = made.core.join(clusters, "cell").select("id", "features", "cell", "cluster")
    border = made.rare.join(made.core.select("id"), "id", "left_anti")
    other = clusters.withColumnRenamed("cell", "cell2")
    own = border.join(clusters, "cell").select("id", "cluster")
    whole = border.join(made.touching.where("far").select("cell", "cell2"), "cell").join(other, "cell2").select("id", "cluster")
    part = _met(border, made.touching, inner.select(F.col("cell").alias("cell2"), F.col("features").alias("_other"), "cluster"), made.width, eps).select("id", "cluster")
    found = inner.select("id", "cluster").unionByName(own.unionByName(whole).unionByName(part).groupBy("id").agg(F.min("cluster").alias("cluster")))
    return made.points.select("id").join(found, "id", "left")


# Points of many axes without cells: leaves of the tree meet in pairs, of which a task holds one.


def _leaves(rows: DataFrame, width: int, eps: float) -> tuple[DataFrame, DataFrame]:
    """id, features and leaf of all points, and pairs a <= b of leaves that may have points within eps.

    A leaf of equal or like points that would be too large is several.
    """
    n, most = rows.count(), max(1, min(LEAF_POINTS, LEAF_NUMBERS // width))
    marked, pairs = _tree(rows.select("id", "features"), width, eps, n, max(LEAF, min(n // 8, most)), "features", "features")
    sizes = marked.groupBy("_code").agg(F.ceil(F.count("*") / most).alias("_parts"))
    parts = sizes.agg(F.max("_parts")).first()[0]
    dealt = written(marked.join(sizes, "_code").select("id", "features", (F.col("_code") * parts + F.pmod(F.xxhash64("id"), F.col("_parts"))).alias("leaf")), "leaves")
    leaf = dealt.select("leaf").distinct().withColumn("_code", F.floor(F.col("leaf") / parts))
    found = pairs.join(leaf.select(F.col("_code").alias("a"), F.col("leaf").alias("_a")), "a").join(leaf.select(F.col("_code").alias("b"), F.col("leaf").alias("_b")), "b")
    return dealt, written(found.where("a < b OR _a <= _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")), "pairs")


def _matched(left: DataFrame, right: DataFrame, pairs: DataFrame, run, schema: str) -> DataFrame:
    """What ``run`` makes of each pair of leaves: of ``left``'s rows of the one and ``right``'s of the other."""
    side = lambda rows, c: rows.join(pairs, F.col("leaf") == F.col(c)).select("a", "b", *[x for x in rows.columns if x != "leaf"])
    other = side(right, "b")
    sides = [side(left, "a").groupBy("a", "b"), other.select(*[F.col(c).alias(c) for c in other.columns]).groupBy("a", "b")]  # columns of its own
    return sides[0].cogroup(sides[1]).applyInArrow(run, schema)


def _near(x, y, eps: float):
    """Which rows of ``y`` are within eps of those of ``x``, AT_ONCE of these at a time, after the place of the first.

    Products decide most pairs; those that rounding could decide are summed axis by axis.
    """
    import numpy as np

    with np.errstate(over="ignore", invalid="ignore"):
        centre = y.mean(0)
        x0, y0 = x - centre, y - centre
        xx, yy = (x0 * x0).sum(1), (y0 * y0).sum(1)
        slack = (x.shape[1] + 8) * 2.0**-50 * (math.sqrt(xx.max()) + math.sqrt(yy.max())) ** 2
        for low in range(0, len(x), AT_ONCE):
            some = slice(low, low + AT_ONCE)
            square = x0[some] @ y0.T
            square *= -2.0
            square += xx[some, None]
            square += yy
            found = square <= eps * eps - slack
            i, j = np.nonzero(~found & ~(square > eps * eps + slack))
            for at in range(0, len(i), 1 << 18):
                p, q = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
                total = np.zeros(len(p))
                for axis in range(x.shape[1]):
                    gap = x[low + p, axis] - y[q, axis]
                    total += gap * gap
                found[p, q] = np.sqrt(total) <= eps
            yield low, found


def _points_of(rows):
    """Ids and features of an Arrow table."""
    import numpy as np

    x = rows.column("features").combine_chunks()
    return rows.column("id").combine_chunks(), x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, 1))


def _counted_core(dealt: DataFrame, pairs: DataFrame, eps: float, least: int) -> DataFrame:
    """The points with ``core``: whether ``least`` points are within eps, themselves included."""

    def run(key, left, right):
        import numpy as np
        import pyarrow as pa

        (ids, x), (others, y) = _points_of(left), _points_of(right)
        n, m = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        for low, found in _near(x, y, eps):
            n[low : low + len(found)] = found.sum(1)
            m += found.sum(0)
        if key[0] == key[1]:
            return pa.table({"id": ids, "n": n})
        return pa.table({"id": pa.concat_arrays([ids, others]), "n": np.concatenate([n, m])})

    kind = dealt.schema["id"].dataType.simpleString()
    near = _matched(dealt, dealt, pairs, run, f"id {kind}, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return written(dealt.join(near, "id").select("id", "features", "leaf", (F.col("n") >= least).alias("core")), "core")


def _forest_links(core: DataFrame, pairs: DataFrame, eps: float) -> DataFrame:
    """Links (a, b) of points that join all that are within eps: of each pair of leaves fewer than it has points."""

    def run(key, left, right):
        import numpy as np
        import pyarrow as pa

        (ids, x), (others, y) = _points_of(left), _points_of(right)
        if not len(x) or not len(y):
            return pa.table({"a": ids[:0], "b": ids[:0]})
        same = key[0] == key[1]
        all_ids = ids if same else pa.concat_arrays([ids, others])
        root = np.arange(len(all_ids))  # of every point, kept flat
        for low, found in _near(x, y, eps):
            i, j = np.nonzero(found)
            i, j = root[low + i], root[j if same else len(x) + j]
            apart = i != j
            links = np.unique(np.stack([i[apart], j[apart]], axis=1), axis=0)
            while len(links):  # the larger root of a link goes to the smallest that it knows
                up = np.arange(len(root))
                np.minimum.at(up, links.max(1), links.min(1))
                while (up[up] != up).any():
                    up = up[up]
                root = up[root]
                links = up[links]
                links = links[links[:, 0] != links[:, 1]]
        member = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": all_ids.take(pa.array(root[member])), "b": all_ids.take(pa.array(member))})

    kind = core.schema["id"].dataType.simpleString()
    return written(_matched(core, core, pairs, run, f"a {kind}, b {kind}"), "links")


def _lowest(border: DataFrame, inner: DataFrame, pairs: DataFrame, eps: float) -> DataFrame:
    """id and the lowest cluster of ``inner`` within eps of each point of ``border``."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        (ids, x), (_, y) = _points_of(left), _points_of(right)
        if not len(x) or not len(y):
            return pa.table({"id": ids[:0], "cluster": pa.array([], pa.int32())})
        none = np.iinfo(np.int32).max
        cluster = right.column("cluster").to_numpy()
        best = np.concatenate([np.where(found, cluster, none).min(1) for _, found in _near(x, y, eps)])
        return pa.table({"id": ids, "cluster": best.astype(np.int32)}).filter(pa.array(best < none))

    both = pairs.unionByName(pairs.where("a < b").selectExpr("b AS a", "a AS b")).join(border.select(F.col("leaf").alias("a")).distinct(), "a", "left_semi")
    kind = border.schema["id"].dataType.simpleString()
    return _matched(border, inner, both, run, f"id {kind}, cluster int").groupBy("id").agg(F.min("cluster").alias("cluster"))


def _scattered_dbscan(rows: DataFrame, width: int, eps: float, least: int) -> DataFrame:
    """``dbscan`` leaf by leaf: once for the counts, once for the links of core points, once for border points, if there are any."""
    from tessella.operators.rfm import positions

    dealt, pairs = _leaves(rows, width, eps)
    counted = _counted_core(dealt, pairs, eps, least)
    core = counted.where("core").drop("core")
    roots = connected_components(_forest_links(core, pairs, eps))
    rooted = written(core.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "features", "leaf", F.coalesce("root", "id").alias("root")), "rooted")
    numbers = positions(rooted.select("root").distinct(), [F.col("root").asc()], "_i").select("root", (F.col("_i") + 1).cast("int").alias("cluster"))
    inner = rooted.join(numbers, "root").select("id", "features", "leaf", "cluster")
    found, border = inner.select("id", "cluster"), counted.where("NOT core").drop("core")
    if not border.isEmpty():
        found = found.unionByName(_lowest(border, inner, pairs, eps))
    return counted.select("id").join(found, "id", "left")


def agglomerated(points: DataFrame, by: list[str], k: int) -> DataFrame:
    """Clusters of each group by merging the two nearest weighted centroids until k are left.

    Merging is sequential and of the third power in the group's size, so a
    group is one task's work; it is meant for the few rows of a summary.
    """
    import numpy as np
    import pandas as pd

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id").reset_index(drop=True)
        centres = np.array(frame["features"].tolist(), float).reshape(len(frame), -1)
        weight, owner = np.ones(len(frame)), np.arange(len(frame))
        # Distances of live clusters; a merge renews one row and column. A merged cluster counts as the last.
        gaps = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))
        np.fill_diagonal(gaps, np.inf)
        live = list(range(len(frame)))
        while len(live) > k:
            among = gaps[np.ix_(live, live)]
            a, b = sorted(live[i] for i in np.unravel_index(np.argmin(among), among.shape))
            centres[a] = (centres[a] * weight[a] + centres[b] * weight[b]) / (weight[a] + weight[b])
            weight[a] += weight[b]
            owner[owner == b] = a
            live = [c for c in live if c not in (a, b)] + [a]
            gaps[a] = gaps[:, a] = np.sqrt(((centres - centres[a]) ** 2).sum(1))
            gaps[a, a] = np.inf
        label = {c: i for i, c in enumerate(live)}
        return frame[[*by, "id"]].assign(cluster=[label[c] for c in owner]).astype({"cluster": "int32"})

    schema = points.select(*by, "id").withColumn("cluster", F.lit(0)).schema
    return points.select(*by, "id", "features").groupBy(*by).applyInPandas(merge, schema)


def soft_clusters(points: DataFrame, k: int, iterations: int = 100) -> tuple[DataFrame, list[list[float]]]:
    """Soft k-means with unit spread: memberships by exp(-d²), centres by weighted means.

    Returns the points with ``probabilities`` and ``cluster``, the last of
    equal memberships, and the centres. One aggregation per iteration.
    """
    given, points = points, written(points.select("id", finite(F.col("features")).alias("features")), "points")
    width = _width(points)
    cells = _cells(width)
    centres = strided_centres(points, k)

    def memberships(centres: list[list[float]]) -> list[Column]:
        raw = [F.exp(-distance(cells, c)) for c in centres]
        total = sum(raw[1:], raw[0])
        return [F.when(total > 0, r / F.when(total > 0, total)).otherwise(1.0 / k) for r in raw]

    for _ in range(iterations):
        p = memberships(centres)
        row = points.agg(*[F.sum(q).alias(f"p{j}") for j, q in enumerate(p)], *[F.sum(q * c).alias(f"s{j}_{i}") for j, q in enumerate(p) for i, c in enumerate(cells)]).first()
        new = [[row[f"s{j}_{i}"] / row[f"p{j}"] for i in range(width)] if row[f"p{j}"] > 1e-10 else centres[j] for j in range(k)]
        if new == centres:
            break
        centres = new
    out = given.withColumn("probabilities", F.array(*memberships(centres)))
    at = F.array_max(F.transform("probabilities", lambda p, i: F.struct(p.alias("p"), i.alias("i"))))
    return out.withColumn("cluster", at["i"]), centres


# Quality.


def davies_bouldin(points: DataFrame) -> DataFrame:
    """Of (features, cluster): the mean over clusters of the worst ratio of spreads to distance."""
    width = _width(points)
    centre = F.array(*[F.avg(c) for c in _cells(width)])
    centres = points.groupBy("cluster").agg(centre.alias("c"))
    gap = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    s = points.join(F.broadcast(centres), "cluster").groupBy("cluster", "c").agg(F.avg(gap(F.col("features"), F.col("c"))).alias("s"))  # one row per cluster
    other = s.select(F.col("cluster").alias("o"), F.col("c").alias("oc"), F.col("s").alias("os"))
    d = gap(F.col("c"), F.col("oc"))
    worst = s.join(F.broadcast(other), F.col("cluster") != F.col("o"), "left").groupBy("cluster").agg(F.coalesce(F.max(F.when(d > 1e-10, (F.col("s") + F.col("os")) / d)), F.lit(0.0)).alias("w"))
    return worst.agg(F.avg("w").alias("davies_bouldin"))


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """Of (features, cluster): spread between clusters over spread within, from sums and squares alone."""
    width = _width(points)
    cells = _cells(width)
    square = sum((c * c for c in cells[1:]), cells[0] * cells[0])
    per = points.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(square).alias("q"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(cells)])
    own = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(1, width)), F.col("s0") * F.col("s0")) / F.col("n")
    total = per.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(own).alias("own"), F.sum("q").alias("q"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
    all_ = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(1, width)), F.col("s0") * F.col("s0")) / F.col("n")
    b, w = F.col("own") - all_, F.col("q") - F.col("own")
    fits = (F.col("k") >= 2) & (w >= 1e-10) & (F.col("n") > F.col("k"))
    return total.select(F.when(fits, (b / F.when(fits, F.col("k") - 1)) / (w / F.when(fits, F.col("n") - F.col("k")))).otherwise(0.0).alias("calinski_harabasz"))


def silhouette(points: DataFrame, alone: float | None = None) -> DataFrame:
    """Exact mean silhouette of (id, features, cluster), plain Euclidean.

    It is defined over all pairs, so the comparisons grow with the square of
    the points; ``fast_silhouette`` needs only sums. Points are dealt into
    blocks of about PAIRED_NUMBERS, every block meets every other as one row of
    a join, and what leaves a pair of blocks is one sum per point and cluster.
    ``alone`` is what the nearest other cluster's distance is where there is
    no other; None makes the score 1. Points with equal ids aren't compared;
    points without a cluster don't count.
    """
    rows = points.select("id", F.col("features").cast("array<double>").alias("features"), F.col("cluster").cast("bigint").alias("cluster")).where(F.col("cluster").isNotNull())
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("width")).first()
    blocks = max(1, -(-size.n * (3 + (size.width or 0)) // PAIRED_NUMBERS))
    tasks = min(blocks * blocks, max(4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks * blocks // PAIRED_A_TASK))
    packed = written(rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("block").agg(F.collect_list(F.struct("id", "features", "cluster")).alias("own")), "blocks")
    asked = packed.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.col("with").cast("bigint").alias("block"), F.col("own").alias("asked"))
    # Each block as often as there are blocks is no side to broadcast, however small the written table looks.
    met = packed.join(asked.hint("merge"), "block").select("asked", "own").repartition(tasks)
    kind = rows.schema["id"].dataType.simpleString()
    sums = met.mapInArrow(_block_sums, f"id {kind}, cluster bigint, oc bigint, n bigint, d double")
    pairs = sums.groupBy("id", "cluster", "oc").agg((F.sum("d") / F.sum("n")).alias("d"))
    same = F.col("oc") == F.col("cluster")
    per = pairs.groupBy("id", "cluster").agg(F.coalesce(F.max(F.when(same, F.col("d"))), F.lit(0.0)).alias("a"), F.min(F.when(~same, F.col("d"))).alias("b"))
    # A single point has no pair, and the score of one that has neither distance.
    per = rows.select("id", "cluster").distinct().join(per, ["id", "cluster"], "left").select(F.coalesce("a", F.lit(0.0)).alias("a"), "b")
    b = F.coalesce("b", F.lit(1.7976931348623157e308 if alone is None else alone))
    top = F.greatest(F.col("a"), b)
    return per.agg(F.avg(F.when(top > 1e-10, (b - F.col("a")) / top).otherwise(0.0)).alias("silhouette"))


def _block_sums(batches):
    """Of each pair of blocks: for every asked point and every cluster of the other block, how many points and the sum of their distances."""
    import numpy as np
    import pyarrow as pa

    def parts(column, i):
        s = column[i].values
        ids, clusters = s.field("id"), s.field("cluster").to_numpy(zero_copy_only=False)
        return ids, s.field("features").flatten().to_numpy(zero_copy_only=False).reshape(len(s), -1), clusters

    for batch in batches:
        for i in range(batch.num_rows):
            ids, x, own = parts(batch.column("asked"), i)
            others, y, kinds = parts(batch.column("own"), i)
            labels, code = np.unique(kinds, return_inverse=True)
            order = np.argsort(code, kind="stable")
            starts = np.searchsorted(code[order], np.arange(len(labels)))
            at, there = ids.to_numpy(zero_copy_only=False), others.to_numpy(zero_copy_only=False)[order]
            step = max(1, LAID_OUT // len(y))
            for low in range(0, len(x), step):
                some = slice(low, low + step)
                gaps = np.sqrt(sum((x[some, j, None] - y[order, j]) ** 2 for j in range(x.shape[1])))
                counted = (at[some, None] != there).astype(np.int64)
                d, n = np.add.reduceat(gaps * counted, starts, axis=1), np.add.reduceat(counted, starts, axis=1)
                row, kind = np.nonzero(n)
                columns = [ids.take(pa.array(low + row)), pa.array(own[some][row]), pa.array(labels[kind]), pa.array(n[row, kind]), pa.array(d[row, kind])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "oc", "n", "d"])


def fast_silhouette(points: DataFrame) -> float:
    """Silhouette by squared distances, which need only sums per cluster."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = points.select(array_to_vector(F.col("features").cast("array<double>")).alias("features"), F.col("cluster").cast("int").alias("prediction"))
    return ClusteringEvaluator().evaluate(rows)


def agreement(labels: DataFrame) -> DataFrame:
    """Adjusted Rand index, share of equal labels and consistency of sizes of (a, b)."""
    cells = labels.groupBy("a", "b").agg(F.count("*").alias("n"))
    pairs = lambda n: n * (n - 1) / 2.0
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias(f"p{c}"))
    whole = cells.agg(F.sum(pairs(F.col("n"))).alias("p"), F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    sizes = cells.select(F.col("a").alias("k"), F.col("n").alias("d")).unionAll(cells.select("b", -F.col("n"))).groupBy("k").agg(F.abs(F.sum("d")).alias("d")).agg(F.sum("d").alias("gap"))
    one = whole.crossJoin(side("a")).crossJoin(side("b")).crossJoin(sizes)  # one row each
    every = pairs(F.col("n"))
    expected = F.col("pa") * F.col("pb") / F.when(every > 0, every)
    most = (F.col("pa") + F.col("pb")) / 2.0
    ari = F.when((F.col("n") < 2) | (F.abs(most - expected) < 1e-10), 1.0).otherwise((F.col("p") - expected) / F.when(F.abs(most - expected) >= 1e-10, most - expected))
    return one.select(F.least(F.greatest(ari, F.lit(-1.0)), F.lit(1.0)).alias("adjusted_rand_index"), (F.col("same") / F.col("n")).alias("correspondence"), (1.0 - F.col("gap") / F.col("n")).alias("size_consistency"))


def quality_score(silhouette_: Column, davies_bouldin_: Column, calinski_harabasz_: Column) -> Column:
    """Mean of the three measures on scales of a hundred; the ratio of spreads reaches its hundred at 10,000."""
    return ((silhouette_ + 1.0) / 2.0 * 100.0 + (1.0 - F.least(davies_bouldin_ / 10.0, F.lit(1.0))) * 100.0 + F.least(calinski_harabasz_ / 100.0, F.lit(100.0))) / 3.0


def quality_report(points: DataFrame, centres: list[list[float]], exact: bool = False) -> DataFrame:
    """One row on (id, features, cluster): the three measures, inertia about the given centres, clusters, overall score.

    The silhouette is that of squared distances, which needs only sums per
    cluster, or with ``exact`` that of all pairs.
    """
    rows = written(points.select("id", "features", "cluster"), "assigned")
    cells = _cells(_width(rows))
    own = None
    for k, centre in enumerate(centres):
        d = distance(cells, centre)
        own = F.when(F.col("cluster") == k, d) if own is None else own.when(F.col("cluster") == k, d)
    sums = rows.agg(F.sum(own).alias("inertia"), (F.max("cluster") + 1).cast("bigint").alias("n_clusters"))
    score = silhouette(rows) if exact else rows.sparkSession.range(1).select(F.lit(fast_silhouette(rows)).alias("silhouette"))
    one = score.crossJoin(davies_bouldin(rows)).crossJoin(calinski_harabasz(rows)).crossJoin(sums)  # one row each
    return one.withColumn("overall_score", quality_score(F.col("silhouette"), F.col("davies_bouldin"), F.col("calinski_harabasz")))


# Choice of k.


def elbow(inertias: list[tuple[int, float]]) -> tuple[int, float]:
    """The k of the sharpest bend, the first of equals, and its confidence."""
    best, sharpest = inertias[0][0], 0.0
    for (_, a), (k, b), (_, c) in zip(inertias, inertias[1:], inertias[2:], strict=False):
        bend = abs((a - b) - (b - c))
        if bend > sharpest:
            best, sharpest = k, bend
    return best, 1.0 / (1.0 + len(inertias) ** 0.25)


def estimate_k(points: DataFrame, low: int, high: int, methods: tuple[str, ...] = ("elbow", "gap_statistic", "silhouette"), exact: bool = False) -> DataFrame:
    """method, k, confidence by each method and by their vote; of equal votes the smallest k.

    One deterministic fit per k serves all methods. The silhouette is that of
    squared distances, which needs only sums per cluster, or with ``exact``
    that of all pairs.
    """
    if not 0 < low <= high:
        raise ValueError(f"k is to be from {low} to {high}")
    spark = points.sparkSession
    points = written(points.select("id", finite(F.col("features")).alias("features")), "points")
    width = _width(points)
    cells = _cells(width)
    ends = points.agg(F.count("*").alias("n"), *[F.min(c).alias(f"a{i}") for i, c in enumerate(cells)], *[F.max(c).alias(f"b{i}") for i, c in enumerate(cells)]).first()
    reference = math.log2(sum((ends[f"b{i}"] - ends[f"a{i}"]) ** 2 / 12.0 for i in range(width)) * ends.n)
    inertias, gaps, silhouettes = [], [], []
    for k in range(low, high + 1):
        model = fit_strided(points, k)
        inertias.append((k, model.inertia))
        if "gap_statistic" in methods:
            gap = nearest(cells, model.centres, "euclidean")[1]
            gaps.append((k, reference - math.log2(points.agg(F.avg(gap).alias("g")).first().g)))
        if "silhouette" in methods:
            labelled = model.transform(points)
            silhouettes.append((k, silhouette(labelled, alone=0.0).first().silhouette if exact else fast_silhouette(labelled)))
    found = {}
    if "elbow" in methods:
        found["elbow"] = elbow(inertias)
    last_best = lambda scores: max(scores, key=lambda s: (s[1], s[0]))
    if gaps:
        k, g = last_best(gaps)
        found["gap_statistic"] = (k, min(max(g / 10.0, 0.0), 1.0))
    if silhouettes:
        found["silhouette"] = last_best(silhouettes)
    votes: dict[int, int] = {}
    for k, _ in found.values():
        votes[k] = votes.get(k, 0) + 1
    most = max(votes.values())
    found["combined"] = (min(k for k, v in votes.items() if v == most), most / len(found))
    return spark.createDataFrame([(m, k, float(c)) for m, (k, c) in found.items()], "method string, k int, confidence double")


def cosine_distance(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, 1.0 - dot(a, b) / norms).otherwise(0.0)
