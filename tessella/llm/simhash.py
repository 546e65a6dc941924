"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are 64 bits. Two link where at most ``radius`` bits differ. If
the bits are cut into more blocks than ``radius``, linked fingerprints agree
in some choice of ``blocks - radius`` whole blocks; such a masked bit pattern
is the upper node under which both fall, and upper nodes are what the cluster
deals out. Below an upper node, fingerprints are sorted by Gray rank, groups
of neighbours share the masked pattern of the bits that all of them have, and
groups of groups likewise; pairs of nodes whose shared bits already differ too
often are pruned whole, with all that lies below. Only edges that join
components are reported, so a dense group of n fingerprints gives fewer than n
edges below each upper node, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import join_hot, packed_rows, row_key, slices
from tessella.operators.graph import connected_components
from tessella.sources.scratch import written
from tessella.sources.tables import table

SEED = 42
SHINGLE = 4
RADIUS = 4

#: Fingerprints below an upper node that are looked for, in the mean.
NODE_MEAN = 2_048
#: Fingerprints below an upper node that one task takes; larger nodes are cut into pieces that meet in pairs.
NODE_MOST = 150_000
FANOUT = 8
#: Pairs of nodes opened at once.
OPENED = 20_000


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Fingerprint of one text; 0 where it has no word."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda done, n: done + n + 1))
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(joined, SEED)
    starts = [0, *[e + 1 for e in ends[:-size]]]
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=True)], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``fp`` (the 64 bits as a signed long) of every row.

    A null text or one without a word has fingerprint 0. Repeated rows stay.
    """
    narrow = docs.select(*keep, F.col(text).alias("_text"))
    schema = narrow.select(*keep).withColumn("fp", F.lit(0).cast("bigint")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            fps = np.array([fingerprint(t) for t in batch.column("_text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(fps)], names=[*keep, "fp"])

    return narrow.mapInArrow(run, schema)


def masks(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of the upper nodes for ``n`` fingerprints.

    The number of blocks grows until a mask has bits enough to leave about
    NODE_MEAN evenly spread fingerprints below a node. Any choice is exact.
    """
    for blocks in range(radius + 1, 17):
        edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
        parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
        found = [sum(c) for c in combinations(parts, blocks - radius)]
        if n / 2 ** min(m.bit_count() for m in found) <= NODE_MEAN or blocks == 16:
            return found
    raise AssertionError


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each bit pattern in the reflected Gray order."""
    out = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class _Levels:
    """The hierarchical index over Gray-sorted fingerprints: patterns and masks of shared bits, level by level."""

    def __init__(self, x: np.ndarray):
        self.pattern = [x]
        self.mask = [np.full(len(x), np.uint64(0xFFFFFFFFFFFFFFFF))]
        while len(self.pattern[-1]) > FANOUT:
            at = np.arange(0, len(self.pattern[-1]), FANOUT)
            ones = np.bitwise_and.reduceat(self.pattern[-1], at)
            some = np.bitwise_or.reduceat(self.pattern[-1], at)
            mask = np.bitwise_and.reduceat(self.mask[-1], at) & ~(ones ^ some)
            self.pattern.append(ones & mask)
            self.mask.append(mask)

    def one_component(self, label: np.ndarray) -> list[np.ndarray]:
        """Per level, the label all members of a node have, or -1."""
        out = [label]
        while len(out) < len(self.pattern):
            at = np.arange(0, len(out[-1]), FANOUT)
            low, high = np.minimum.reduceat(out[-1], at), np.maximum.reduceat(out[-1], at)
            out.append(np.where(low == high, low, -1))
        return out


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels after joining a[i] with b[i]; a label is the smallest position of its component."""
    label = label.copy()
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        low, high = np.minimum(la, lb)[differ], np.maximum(la, lb)[differ]
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def linked(x: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For distinct fingerprints, the position of each one's component among them: the smallest member's."""
    n = len(x)
    label = np.arange(n)
    if n < 2:
        return label
    if n <= 64:
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
        a, b = np.nonzero(np.triu(near, 1))
        return _merge(label, a, b) if len(a) else label
    order = np.argsort(gray_rank(x), kind="stable")
    s = x[order]
    for step in (1, 2, 3):  # neighbours in Gray order settle most of a dense group before the search
        close = np.flatnonzero(np.bitwise_count(s[step:] ^ s[:-step]) <= radius)
        label = _merge(label, close, close + step)
    index = _Levels(s)
    whole = index.one_component(label)
    top = len(index.pattern) - 1
    a, b = np.triu_indices(len(index.pattern[top]))
    stack, found = [(top, a, b)], []
    while stack:
        level, a, b = stack.pop()
        if len(a) > OPENED:
            stack += [(level, a[i : i + OPENED], b[i : i + OPENED]) for i in range(0, len(a), OPENED)]
            continue
        differ = np.bitwise_count((index.pattern[level][a] ^ index.pattern[level][b]) & index.mask[level][a] & index.mask[level][b]) <= radius
        differ &= (whole[level][a] < 0) | (whole[level][a] != whole[level][b])
        a, b = a[differ], b[differ]
        if not len(a):
            continue
        if level == 0:
            found.append((a, b))
            if sum(len(p) for p, _ in found) > 4 * n or len(a) > 1_000:
                label = _merge(label, np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found]))
                whole, found = index.one_component(label), []
            continue
        k = np.arange(FANOUT)
        p = (a[:, None, None] * FANOUT + k[None, :, None]).repeat(FANOUT, 2).ravel()
        q = (b[:, None, None] * FANOUT + k[None, None, :]).repeat(FANOUT, 1).ravel()
        size = len(index.pattern[level - 1])
        fits = (p < size) & (q < size) & ((p < q) if level == 1 else (p <= q))
        stack.append((level - 1, p[fits], q[fits]))
    if found:
        label = _merge(label, np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found]))
    least = np.full(n, n)
    np.minimum.at(least, label, order)
    out = np.empty(n, np.int64)
    out[order] = least[label]
    return out


def _edges_of(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Joining edges within each run of equal keys."""
    a, b = [], []
    if not len(fp):
        return a, b
    cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)], strict=True):
        if end - start > 1:
            x = np.unique(fp[start:end])
            root = linked(x, radius)
            moved = np.flatnonzero(root != np.arange(len(x)))
            a.append(x[moved].view(np.int64))
            b.append(x[root[moved]].view(np.int64))
    return a, b


def edges(fps: DataFrame, radius: int = RADIUS, node_most: int = NODE_MOST) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` as their links do."""
    spark = fps.sparkSession
    n = fps.count()
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    nodes = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("node")) for t, m in enumerate(masks(n, radius))])
    dealt = fps.select("fp", F.explode(nodes).alias("_")).select("fp", "_.t", "_.node")
    sizes = dealt.groupBy("t", "node").agg(F.count("*").alias("n")).where(F.col("n") > node_most)
    large = written(sizes.select(F.col("t").alias("_t"), F.col("node").alias("_node"), F.ceil(F.col("n") / node_most).cast("int").alias("pieces")), "nodes")
    if large.isEmpty():
        cells = dealt.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    else:  # each piece of a large node meets each other one in a cell of their own
        cut = dealt.join(large, (F.col("t") == F.col("_t")) & (F.col("node") == F.col("_node")), "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
        cut = cut.withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
        cells = cut.select("fp", "t", "node", "piece", other.alias("other")).select("fp", "t", "node", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("t", "node", "i", "j")
        key, fp = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate([key, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names], 1)])
            fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
            if len(fp) < 50_000 or (key[0] == key[-1]).all():
                continue
            whole = int(np.flatnonzero((key[:-1] != key[-1]).any(axis=1))[-1]) + 1
            a, b = _edges_of(key[:whole], fp[:whole], radius)
            key, fp = key[whole:], fp[whole:]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
        a, b = _edges_of(key, fp, radius)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c) for c in ("t", "node", "i", "j")]
    return cells.repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(run, "a bigint, b bigint")


def components(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp``, ``root`` for the distinct fingerprints that link to another; the rest are their own roots."""
    return connected_components(edges(fps, radius)).withColumnRenamed("node", "fp")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``docs``.

    A null or wordless text has fingerprint 0 and links like any other. A
    component without any doc_id has a null component_id. Repeated rows each
    get their row; an empty table gives none.
    """
    rows = written(fingerprints(docs), "fingerprints")
    least = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("members")), "distinct")
    roots = components(least.select("fp"), radius)
    per = roots.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    of = join_hot(roots, per, ["root"], "members", roots.count()).select("fp", "component_id")
    to = written(least.join(of, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "members"), "components")
    return join_hot(rows, to, ["fp"], "members", rows.count()).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with one of each component kept: that of the smallest doc_id, nulls last.

    Of rows that agree in doc_id and text one stays. All columns stay as they are.
    """
    held = packed_rows(docs).select("_row", *row_key())
    narrow = held.select(F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"), "_id", "_hash")
    rows = written(fingerprints(narrow, keep=("doc_id", "_id", "_hash")), "fingerprints")
    # The first row of each fingerprint is all that the components need.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "_id", "_hash")).alias("first")
    own = written(rows.groupBy("fp").agg(first, F.count("*").alias("members")), "distinct")
    roots = components(own.select("fp"), radius)
    of = own.join(roots, "fp", "left").withColumn("_component", F.coalesce("root", "fp"))
    first = of.groupBy("_component").agg(F.min(F.struct("first", "members")).alias("_"))
    winners = first.groupBy(F.col("_.first._id").alias("_id"), F.col("_.first._hash").alias("_hash")).agg(F.max("_.members").alias("members"))
    held = join_hot(held, written(winners, "winners"), ["_id", "_hash"], "members", rows.count())
    # Partial aggregation leaves one row a task of those that agree in doc_id and text.
    order = [f"_row.`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString()]
    return held.groupBy("_id", "_hash").agg(F.min_by("_row", F.xxhash64(*order)).alias("_row")).select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
