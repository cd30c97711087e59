"""Sharding by a k-d tree: cut at distributed weighted medians along the widest metadata dimension.

A node holds a box of metadata space and a number of leaves; it is cut where the bytes below come nearest to its left leaves'
share. The median is found by histograms that narrow around it: rows are never sorted or moved, each pass returns a bounded
number of sums. Rows that agree in the cut dimension are ordered by the checksum of their text and a hash of the row's id, so
equal texts stay neighbours and a value of any weight can be divided.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut_lineage, numbered

#: Sums returned by one pass at most.
MAX_SUMS = 1 << 18
TIE_BITS = 62


@dataclass
class Node:
    leaves: int
    first: int  # number of its first leaf
    bytes: int = 0
    dim: int = 0
    cut: tuple[int, int] | None = None  # rows below (value, tie) go left
    left: int = -1
    right: int = -1


@dataclass
class Tree:
    """Nodes as arrays, for descent in tasks. Its size follows the number of leaves, not of rows."""

    nodes: list[Node] = field(default_factory=list)

    def arrays(self) -> dict[str, np.ndarray]:
        cut = [n.cut or (0, 0) for n in self.nodes]
        return {
            "dim": np.array([n.dim for n in self.nodes], np.int64),
            "value": np.array([c[0] for c in cut], np.int64),
            "tie": np.array([c[1] for c in cut], np.int64),
            "left": np.array([n.left for n in self.nodes], np.int64),
            "right": np.array([n.right for n in self.nodes], np.int64),
        }


def descend(a: dict[str, np.ndarray], dims: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """The deepest node of each row (``dims``: rows x dimensions)."""
    at = np.zeros(len(tie), np.int64)
    while True:
        moving = np.flatnonzero(a["left"][at] >= 0)
        if not len(moving):
            return at
        node = at[moving]
        value = dims[moving, a["dim"][node]]
        below = (value < a["value"][node]) | ((value == a["value"][node]) & (tie[moving] < a["tie"][node]))
        at[moving] = np.where(below, a["left"][node], a["right"][node])


def _node_of(shared, dims: list[str]) -> Column:
    @F.arrow_udf(T.LongType())
    def node(tie, *columns):
        import pyarrow as pa

        return pa.array(descend(shared.value, np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1), tie.to_numpy(zero_copy_only=False)))

    return node(F.col("__tie"), *[F.col(d) for d in dims])


@dataclass
class Search:
    """A narrowing search for the cut of one node, first among values, then among ties of one value."""

    node: int
    want: float
    lo: int
    hi: int  # inclusive
    below: int = 0
    value: int | None = None


def _bins(shared, dims: list[str], bins: int) -> Column:
    """node * bins + bin of rows inside the searched range of their node; null elsewhere."""

    @F.arrow_udf(T.LongType())
    def place(tie, *columns):
        import pyarrow as pa

        a, found = shared.value
        dims_, ties = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1), tie.to_numpy(zero_copy_only=False)
        at = descend(a, dims_, ties)
        out = np.full(len(ties), -1, np.int64)
        value = dims_[np.arange(len(ties)), a["dim"][at]]
        key = np.where(found["on_tie"][at], ties, value)
        lo, hi, width = found["lo"][at], found["hi"][at], found["width"][at]
        inside = found["active"][at] & (key >= lo) & (key <= hi) & (~found["on_tie"][at] | (value == found["value"][at]))
        out[inside] = at[inside] * bins + (key[inside] - lo[inside]) // width[inside]
        return pa.array(out, mask=~inside)

    return place(F.col("__tie"), *[F.col(d) for d in dims])


def _find_cuts(points: DataFrame, tree: Tree, dims: list[str], searches: list[Search], slack: float) -> dict[int, tuple[int, int]]:
    spark, cuts = points.sparkSession, {}
    while searches:
        bins = max(16, min(1024, MAX_SUMS // len(searches)))
        n = len(tree.nodes)
        found = {k: np.zeros(n, np.int64) for k in ("lo", "hi", "width", "value")} | {k: np.zeros(n, bool) for k in ("active", "on_tie")}
        for s in searches:
            found["active"][s.node], found["on_tie"][s.node] = True, s.value is not None
            found["lo"][s.node], found["hi"][s.node], found["value"][s.node] = s.lo, s.hi, s.value or 0
            found["width"][s.node] = (s.hi - s.lo) // bins + 1
        found["width"] = np.maximum(found["width"], 1)
        shared = spark.sparkContext.broadcast((tree.arrays(), found))
        key = F.when(F.col("__on"), F.col("__tie")).otherwise(F.col("__v"))
        placed = points.withColumn("__bin", _bins(shared, dims, bins)).where("__bin IS NOT NULL")
        by_node = F.element_at(F.array(*[F.col(d) for d in dims]), F.element_at(F.lit([s.dim + 1 for s in tree.nodes]), (F.floor(F.col("__bin") / bins) + 1).cast("int")))
        on = F.element_at(F.lit([bool(x) for x in found["on_tie"]]), (F.floor(F.col("__bin") / bins) + 1).cast("int"))
        sums = (
            placed.withColumn("__v", by_node).withColumn("__on", on).withColumn("__k", key)
            .groupBy("__bin").agg(F.sum("size").alias("bytes"), F.min("__k").alias("lo"), F.max("__k").alias("hi")).collect()
        )
        own: dict[int, list] = {}
        for r in sorted(sums, key=lambda r: r["__bin"]):
            own.setdefault(r["__bin"] // bins, []).append(r)
        later = []
        for s in searches:
            total = s.below
            rows = own.get(s.node, [])
            for k, r in enumerate(rows):
                if total + r.bytes >= s.want or k == len(rows) - 1:
                    break
                total += r.bytes
            if not rows:
                cuts[s.node] = (s.lo, 0) if s.value is None else (s.value, s.lo)
                continue
            s.below, s.lo, s.hi = total, int(r.lo), int(r.hi)
            under, over = s.want - s.below, s.below + r.bytes - s.want
            if min(abs(under), abs(over)) <= slack or (s.value is not None and s.lo == s.hi):
                edge = s.lo if abs(under) <= abs(over) else s.hi + 1
                cuts[s.node] = (edge, 0) if s.value is None else (s.value, edge)
            elif s.lo == s.hi:  # one value holds the median: divide it by ties
                s.value, s.lo, s.hi = s.lo, 0, (1 << TIE_BITS) - 1
                later.append(s)
            else:
                later.append(s)
        searches = later
    return cuts


def grow(points: DataFrame, dims: list[str], leaves: int, slack_share: float = 0.001) -> Tree:
    """The tree of ``leaves`` leaves over a written table with ``size``, ``__tie`` and the integer columns ``dims``.

    Each cut misses its share by at most ``slack_share`` of a leaf's bytes or one row.
    """
    tree = Tree([Node(leaves, 0)])
    widest: np.ndarray | None = None
    level = [0]
    while level := [k for k in level if tree.nodes[k].leaves > 1]:
        shared = points.sparkSession.sparkContext.broadcast(tree.arrays())
        boxes = points.groupBy(_node_of(shared, dims).alias("node")).agg(
            F.sum("size").alias("bytes"), *[f(d).alias(f"{n}{i}") for i, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))]
        )
        box = {r.node: r for r in boxes.collect()}
        searches = []
        for k in level:
            node, r = tree.nodes[k], box.get(k)
            if r is None:  # no rows: an empty side
                node.cut = (0, 0)
                continue
            extent = np.array([r[f"hi{i}"] - r[f"lo{i}"] for i in range(len(dims))], float)
            if widest is None:
                widest = np.maximum(extent, 1)
                total = r.bytes
            node.bytes, node.dim = r.bytes, int(np.argmax(extent / widest))
            searches.append(Search(k, r.bytes * (node.leaves // 2) / node.leaves, int(r[f"lo{node.dim}"]), int(r[f"hi{node.dim}"])))
        if widest is None:
            return tree
        for k, cut in _find_cuts(points, tree, dims, searches, slack_share * total / leaves).items():
            tree.nodes[k].cut = cut
        below = []
        for k in level:
            node = tree.nodes[k]
            half = node.leaves // 2
            node.left, node.right = len(tree.nodes), len(tree.nodes) + 1
            tree.nodes += [Node(half, node.first), Node(node.leaves - half, node.first + half)]
            below += [node.left, node.right]
        level = below
    return tree


def _ordinal(column: Column) -> Column:
    """A place for a label on a line of 2**32: its checksum. Null comes before all."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) + 1, F.lit(0)).cast("long")


def metadata_points(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the dimensions source, language and length (in 1/1024 of a doubling)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = (F.length(text) + 1).cast("long")
    crc = F.crc32(text)
    # the id decides among equal texts; rows of one id and text are alike and their order does not matter
    tie = crc * (1 << (TIE_BITS - 32)) + F.pmod(F.xxhash64(F.col("doc_id"), F.lit("tie")), F.lit(1 << (TIE_BITS - 32)))
    return docs.select(
        "doc_id",
        size.alias("size"),
        crc.alias("text_crc32"),
        _ordinal(F.col("source")).alias("__source"),
        _ordinal(F.col("lang")).alias("__lang"),
        F.floor(F.log2(size) * 1024).cast("long").alias("__length"),
        tie.alias("__tie"),
    )


DIMENSIONS = ["__source", "__lang", "__length"]


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, one row per document row.

    Give the number of ``shards``, or ``target_bytes``: then there are as many leaves as keep their mean at or below it. size: UTF-8
    bytes of the text plus 1, for null as for empty texts; slots are gapless from 0 in each shard. Shards have nearly equal
    bytes unless single rows are larger than that; repeated rows of one id and text may share a shard. An empty table: no rows.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    points = cut_lineage(metadata_points(docs))
    if shards is None:
        total = points.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    tree = grow(points, DIMENSIONS, shards)
    shared = points.sparkSession.sparkContext.broadcast(tree.arrays())
    leaf = F.element_at(F.lit([n.first for n in tree.nodes]), (F.col("__node") + 1).cast("int"))
    placed = points.withColumn("__node", _node_of(shared, DIMENSIONS)).select("doc_id", "size", "text_crc32", leaf.cast("int").alias("shard"))
    return numbered(placed, "shard", ["text_crc32", "doc_id"], "slot")
