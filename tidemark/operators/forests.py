"""Random forests over binned rows: trees are grown and tested in tasks, the driver never holds one.

Values are cut into at most ``MAX_BINS`` bins, as ``pyspark.ml`` does. Rows that share all bins and the label are one cell with a
count; a tree's bag draws each cell's weight from the Poisson law of its count, which is what drawing the rows one by one gives.
Cells lie in numbered blocks. The trees of a forest whose cells fit a task are dealt over a few tasks: each reads the cells once,
grows its trees one after the other, lets the test cells fall through each and hands on the sums, so that neither cells nor trees
are sent once per tree. Of a larger forest the upper splits are found by histograms summed over the blocks, until each part fits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

MAX_BINS = 32
#: Cells of a block, and most cells a task grows a tree or subtree from.
BLOCK_CELLS = 65_536
TASK_CELLS = 1_000_000
#: Nodes whose histograms are held at once; rows below which a node is cut by its sorted rows instead.
NODES = 512
FEW_ROWS = 64
#: Bits of a class and of a weight that are sorted along.
LABEL_BITS, WEIGHT_BITS = 8, 20
_TAIL_BITS = LABEL_BITS + WEIGHT_BITS
#: Tasks that read blocks, at most; tasks that grow or test parts of trees, and tasks that grow some trees of a forest, per core.
TASKS = 400
TASKS_PER_CORE = 4
FOREST_TASKS_PER_CORE = 8

_BLOCK = "forest int, block int, size int, bins binary, labels binary, counts binary"
_DEALT = "forest int, tree int, leaf long, block int, size int, places binary, bins binary, labels binary, counts binary"
_GROWN = "forest int, tree int, leaf long, feature binary, cut binary, left binary, prob binary"
_SUMS = "forest int, block int, grown int, labels binary, counts binary, shares binary"


@dataclass
class Law:
    """What fixes a forest besides its rows; ``tops`` holds the upper splits {path: (feature, cut)} of (forest, tree)."""

    trees: int
    seed: int
    max_depth: int
    n_features: int
    n_classes: int
    tops: dict[tuple[int, int], dict[int, tuple[int, int]]] = field(default_factory=dict)


# ---- bins and cells -------------------------------------------------------
def fit_cuts(rows: DataFrame, cols: Sequence[str]) -> dict[int, list[np.ndarray]]:
    """Per forest and column the values at which bins end: between all values if they are few, else at quantiles."""

    def few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for b in batches:
            for forest, part in b.groupby("forest"):
                for i, c in enumerate(cols):
                    got = seen.get((forest, i), np.empty(0))
                    if len(got) <= MAX_BINS:  # one more than the bins tells that there are too many
                        seen[forest, i] = np.union1d(got, part[c].to_numpy())[: MAX_BINS + 1]
        for (forest, i), v in seen.items():
            yield pd.DataFrame({"forest": np.int32(forest), "at": np.int32(i), "v": v})

    values = rows.select("forest", *cols).mapInPandas(few, "forest int, at int, v double")
    kept = values.groupBy("forest", "at").agg(F.slice(F.sort_array(F.collect_set("v")), 1, MAX_BINS + 1).alias("v"))
    found = {(r["forest"], r["at"]): np.array(r["v"], float) for r in kept.collect()}
    wide = sorted({i for (_, i), v in found.items() if len(v) > MAX_BINS})
    edges = {}
    if wide:
        probs = [i / MAX_BINS for i in range(1, MAX_BINS)]
        cut = rows.groupBy("forest").agg(*[F.percentile_approx(cols[i], probs, 10_000).alias(f"q{i}") for i in wide])
        edges = {(r["forest"], i): np.unique(np.array(r[f"q{i}"], float)) for r in cut.collect() for i in wide}
    ends = {k: edges[k] if len(v) > MAX_BINS else (v[:-1] + v[1:]) / 2 for k, v in found.items()}
    return {f: [ends[f, i] for i in range(len(cols))] for f in {k[0] for k in found}}


def to_cells(rows: DataFrame, cols: Sequence[str], cuts: Mapping[int, Sequence[np.ndarray]]) -> DataFrame:
    """``forest, label, bins, n``: rows that share all bins and the label counted together."""

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forest = b.column("forest").to_numpy(zero_copy_only=False)
            x = [b.column(c).to_numpy(zero_copy_only=False) for c in cols]
            bins = np.zeros((len(forest), len(cols)), "uint8")
            for f in np.unique(forest):
                at = np.flatnonzero(forest == f)
                for i, v in enumerate(x):
                    bins[at, i] = np.searchsorted(cuts[int(f)][i], v[at])
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(cols)), len(forest), [None, pa.py_buffer(bins.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("forest"), b.column("label"), packed.cast(pa.binary())], ["forest", "label", "bins"])

    return rows.select("forest", "label", *cols).mapInArrow(binned, "forest int, label int, bins binary").groupBy("forest", "label", "bins").agg(
        F.count(F.lit(1)).alias("n")
    )


def to_blocks(cells: DataFrame, block_cells: int) -> tuple[DataFrame, dict[int, int], int]:
    """Cells in blocks dealt by hash, cells per forest, and the number of blocks. A block is sorted, so that draws for it repeat."""
    cells = cut_lineage(cells)
    sizes = {r["forest"]: r["count"] for r in cells.groupBy("forest").count().collect()}
    counts = {f: math.ceil(n / block_cells) for f, n in sizes.items()}
    per = F.create_map(*[F.lit(v) for f, n in counts.items() for v in (f, n)])

    def pack(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["bins", "label"])
        return pd.DataFrame([(
            key[0], key[1], len(b), b"".join(b["bins"]), b["label"].to_numpy("int32").tobytes(), b["n"].to_numpy("int64").tobytes()
        )], columns=["forest", "block", "size", "bins", "labels", "counts"])

    block = F.pmod(F.xxhash64("bins", "label"), per[F.col("forest")].cast("long")).cast("int")
    total = sum(counts.values())
    blocks = cut_lineage(cells.withColumn("block", block).groupBy("forest", "block").applyInPandas(pack, _BLOCK))
    return blocks.repartition(min(total, TASKS), "forest", "block"), sizes, total


def _read(r, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.frombuffer(r.bins, "uint8").reshape(-1, n_features), np.frombuffer(r.labels, "int32").astype("int64"),
            np.frombuffer(r.counts, "int64"))


def _bag(r, counts: np.ndarray, tree: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, r.block]).poisson(counts)


# ---- splits ---------------------------------------------------------------
def _subsets(paths: np.ndarray, tree: int, law: Law) -> np.ndarray:
    """The columns a node may split by, from a hash of its tree and place."""
    z = paths.astype("uint64")[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(law.n_features, dtype="uint64") * np.uint64(0xD1B54A32D192ED03)
    z = z + np.uint64((law.seed * 1_000_003 + int(tree) * 8191 + 1) % 2**63)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return np.argsort(z ^ (z >> np.uint64(31)), axis=1, kind="stable")[:, : math.ceil(math.sqrt(law.n_features))]


def _best_cut(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gini gain and place of the best cut of each histogram [node, bin, class]."""
    left = np.cumsum(h, axis=1)
    total = left[:, -1]
    left = left[:, :-1]
    right = total[:, None] - left
    nl, nr, n = left.sum(2), right.sum(2), total.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        both = (left * left).sum(2) / nl + (right * right).sum(2) / nr
        gain = both - ((total * total).sum(1) / n)[:, None]
    gain = np.where((nl > 0) & (nr > 0), gain, 0.0)
    cut = gain.argmax(1)
    return gain[np.arange(len(h)), cut] / np.maximum(n, 1), cut


def _histograms(bins: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, column: np.ndarray, nodes: int, n_classes: int) -> np.ndarray:
    place = (at * MAX_BINS + bins.ravel().take(np.arange(len(at)) * bins.shape[1] + column)) * n_classes + y
    return np.bincount(place, w, nodes * MAX_BINS * n_classes).reshape(nodes, MAX_BINS, n_classes)


def _dense_cuts(here: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, pick: np.ndarray, n_classes: int) -> Iterator[tuple]:
    """Per column of ``pick``: gain and place of the best cut of each node, from histograms. Rows are sorted by node ``at``."""
    m = len(pick)
    starts = np.searchsorted(at, np.arange(0, m + NODES, NODES))
    for j in range(pick.shape[1]):
        gain, cut = np.zeros(m), np.zeros(m, "int64")
        for i, a in enumerate(range(0, m, NODES)):
            z, own = min(m, a + NODES), slice(starts[i], starts[i + 1])
            h = _histograms(here[own], y[own], w[own], at[own] - a, pick[:, j].take(at[own]), z - a, n_classes)
            gain[a:z], cut[a:z] = _best_cut(h)
        yield gain, cut


def _sorted_cuts(here: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, pick: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
    """The same for nodes of few rows, from their sorted rows: only cuts at bins that occur are looked at, the others gain no more."""
    m, k = counts.shape
    tail = (y << WEIGHT_BITS) | w
    first, step = np.searchsorted(at, np.arange(m)), np.arange(len(at)) * here.shape[1]
    flat, n = here.ravel(), counts.sum(1)
    squares = (counts * counts).sum(1) / n
    for j in range(pick.shape[1]):
        gain, cut = np.zeros(m), np.zeros(m, "int64")
        # node, bin, class and weight in one number
        packed = np.sort((((at * MAX_BINS) | flat.take(step + pick[:, j].take(at))) << _TAIL_BITS) | tail)
        key, weight = packed >> _TAIL_BITS, packed & ((1 << WEIGHT_BITS) - 1)
        node = key // MAX_BINS
        ends = np.flatnonzero((key[1:] != key[:-1]) & (node[1:] == node[:-1]))
        if len(ends):
            of = node[ends]
            nl, left2, right2 = np.zeros(len(ends)), np.zeros(len(ends)), np.zeros(len(ends))
            label = (packed >> WEIGHT_BITS) & (2**LABEL_BITS - 1)
            for c in range(k):
                upto = np.cumsum(np.where(label == c, weight, 0))
                before = upto[first - 1]
                before[first == 0] = 0
                left = (upto[ends] - before[of]).astype(float)
                right = counts[of, c] - left
                nl, left2, right2 = nl + left, left2 + left * left, right2 + right * right
            found = left2 / nl + right2 / (n[of] - nl) - squares[of]
            begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            most = np.maximum.reduceat(found, begins)
            best = np.flatnonzero(found == np.repeat(most, np.diff(np.r_[begins, len(of)])))
            best = best[np.r_[True, of[best[1:]] != of[best[:-1]]]]
            gain[of[begins]], cut[of[begins]] = most / np.maximum(n[of[begins]], 1), key[ends[best]] % MAX_BINS
        yield gain, cut


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, root: int, tree: int, law: Law) -> tuple[np.ndarray, ...]:
    """Feature (-1: leaf), cut, left child (right: the next) and class shares of every node, level by level from ``root``.

    As in ``pyspark.ml``, two leaves of one node that predict the same class are merged.
    """
    k, out, levels, paths, first = law.n_classes, [], [], np.array([root]), 0
    # rows are kept in the order of their nodes, in records of a size that is copied fast
    rows, wide = np.flatnonzero(w), 1 << (law.n_features - 1).bit_length()
    x = np.zeros((len(rows), wide), "uint8")
    x[:, : law.n_features] = bins.take(rows, axis=0)
    y, w, at = y.take(rows), w.take(rows).astype("int64"), np.zeros(len(rows), "int64")
    few = FEW_ROWS if k <= 2**LABEL_BITS and w.max(initial=0) < 2**WEIGHT_BITS else 0
    while len(paths):
        m = len(paths)
        counts = np.bincount(at * k + y, w, m * k).reshape(m, k)
        feature, cut = np.full(m, -1, "int32"), np.zeros(m, "uint8")
        if int(paths[0]).bit_length() <= law.max_depth:
            mixed = counts.max(1) < counts.sum(1)
            small = np.bincount(at, minlength=m) < few
            for own, by_rows in ((mixed & ~small, False), (mixed & small, True)):  # the others are leaves
                nodes = np.flatnonzero(own)
                if not len(nodes):
                    continue
                mine = np.flatnonzero(own.take(at))
                held = x.take(mine, axis=0), y.take(mine), w.take(mine), (np.cumsum(own) - 1).take(at.take(mine)), _subsets(paths[nodes], tree, law)
                pick, cuts = held[-1], _sorted_cuts(*held, counts[nodes]) if by_rows else _dense_cuts(*held, k)
                gain = np.full(len(nodes), 1e-12)
                for j, (g, c) in enumerate(cuts):
                    better = np.flatnonzero(g > gain)
                    gain[better], feature[nodes[better]], cut[nodes[better]] = g[better], pick[better, j], c[better]
        split = feature >= 0
        number = np.cumsum(split) - 1
        out.append((feature, cut, np.where(split, first + m + 2 * number, -1).astype("int32"), counts / counts.sum(1, keepdims=True)))
        keep = np.flatnonzero(split.take(at))
        at = at.take(keep)
        at = 2 * number.take(at) + (x.ravel().take(keep * wide + feature.take(at)) > cut.take(at))
        order = np.sort((at << 32) | np.arange(len(at)))
        keep, at = keep.take(order & 0xFFFFFFFF), order >> 32
        x, y, w = x.take(keep, axis=0), y.take(keep), w.take(keep)
        paths = (2 * paths[split][:, None] + np.array([0, 1])).ravel()
        levels.append((first, first + m))
        first += m
    feature, cut, left, prob = (np.concatenate(part) for part in zip(*out))
    says = prob.argmax(1)
    for a, z in reversed(levels):
        node = np.flatnonzero(feature[a:z] >= 0) + a
        one, two = left[node], left[node] + 1
        feature[node[(feature[one] < 0) & (feature[two] < 0) & (says[one] == says[two])]] = -1
    return feature, cut, left, prob


def _leaf_shares(model: Sequence[np.ndarray], bins: np.ndarray) -> np.ndarray:
    """Class shares of the leaf that each row of ``bins`` falls into."""
    feature, cut, left, prob = model
    node, rows = np.zeros(len(bins), "int64"), np.arange(len(bins))
    while len(rows):
        rows = rows[feature[node[rows]] >= 0]
        here = node[rows]
        node[rows] = left[here] + (bins[rows, feature[here]] > cut[here])
    return prob[node]


# ---- upper splits of large trees ------------------------------------------
def _paths(bins: np.ndarray, top: Mapping[int, tuple[int, int]]) -> np.ndarray:
    """Place (1: root, children of i: 2i and 2i + 1) each row reaches under the upper splits."""
    at = np.ones(len(bins), "int64")
    for path in sorted(top):
        feature, cut = top[path]
        rows = np.flatnonzero(at == path)
        at[rows] = 2 * path + (bins[rows, feature] > cut)
    return at


def split_tops(blocks: DataFrame, sizes: Mapping[int, int], law: Law, task_cells: int) -> dict[tuple[int, int, int], list[float]]:
    """Fill ``law.tops`` until each part has at most ``task_cells`` cells; returns class weights of larger parts that do not split.

    A pass sums, over the blocks, one histogram per open part. Splits are chosen in tasks; the driver gets a row for each.
    """
    k, closed = law.n_classes, {}
    open_ = {(f, t): {1} for f, n in sizes.items() if n > task_cells for t in range(law.trees)}
    while open_:
        now = {key: (sorted(paths), dict(law.tops.get(key, {}))) for key, paths in open_.items()}

        def counted(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            sums: dict = {}
            for b in batches:
                for r in b.itertuples():
                    bins, y, n = _read(r, law.n_features)
                    for (forest, tree), (paths, top) in now.items():
                        if forest != r.forest:
                            continue
                        w = _bag(r, n, tree, law.seed)
                        kept = np.flatnonzero(w)
                        at = _paths(bins[kept], top)
                        for path in paths:
                            rows = kept[at == path]
                            zero = np.zeros(len(rows), "int64")
                            pick = _subsets(np.array([path]), tree, law)[0]
                            # weights per class, and cells as one more
                            h = np.stack([np.concatenate([
                                _histograms(bins[rows], y[rows], w[rows], zero, zero + c, 1, k)[0],
                                _histograms(bins[rows], zero, zero + 1, zero, zero + c, 1, 1)[0],
                            ], axis=1) for c in pick])
                            key = (forest, tree, path)
                            sums[key] = sums[key] + h if key in sums else h
            for (forest, tree, path), h in sums.items():
                yield pd.DataFrame({"forest": np.int32(forest), "tree": np.int32(tree), "leaf": np.int64(path), "h": [h.tobytes()]})

        def chosen(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
            h = sum(np.frombuffer(v, "float64") for v in b["h"]).reshape(-1, MAX_BINS, k + 1)
            pick = _subsets(np.array([key[2]]), key[1], law)[0]
            whole = h[0, :, :k].sum(0)
            gain, cut = _best_cut(h[:, :, :k])
            j = int(gain.argmax())
            left = h[j, : cut[j] + 1, k].sum()
            if whole.max() == whole.sum() or gain[j] <= 1e-12 or int(key[2]).bit_length() > law.max_depth:
                found = (-1, 0, 0, 0)
            else:
                found = (int(pick[j]), int(cut[j]), int(left), int(h[j, :, k].sum() - left))
            return pd.DataFrame([(*key, *found, whole.tolist())], columns=["forest", "tree", "leaf", "feature", "cut", "n_left", "n_right", "whole"])

        sums = blocks.mapInPandas(counted, "forest int, tree int, leaf long, h binary")
        splits = sums.groupBy("forest", "tree", "leaf").applyInPandas(
            chosen, "forest int, tree int, leaf long, feature int, cut int, n_left long, n_right long, whole array<double>"
        ).collect()
        open_ = {}
        for r in splits:
            key = (r["forest"], r["tree"])
            if r["feature"] < 0:
                closed[(*key, r["leaf"])] = r["whole"]
                continue
            law.tops.setdefault(key, {})[r["leaf"]] = (r["feature"], r["cut"])
            for path, n in ((2 * r["leaf"], r["n_left"]), (2 * r["leaf"] + 1, r["n_right"])):
                if n > task_cells:
                    open_.setdefault(key, set()).add(path)
    return closed


# ---- forests --------------------------------------------------------------
def _deal(blocks: DataFrame, law: Law, bag: bool, skip: Mapping | None = None) -> DataFrame:
    """Cells of each block once per tree, by the part of the tree they fall into; counts are the weights in the tree's bag."""
    names = [c.split()[0] for c in _DEALT.split(", ")]

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                bins, y, n = _read(r, law.n_features)
                for tree in range(law.trees):
                    w = _bag(r, n, tree, law.seed) if bag else n
                    kept = np.flatnonzero(w)
                    at = _paths(bins[kept], law.tops.get((r.forest, tree), {}))
                    out = []
                    for path in np.unique(at):
                        if skip and (r.forest, tree, path) in skip:
                            continue
                        rows = kept[at == path]
                        out.append((r.forest, tree, path, r.block, len(rows), rows.astype("int32").tobytes(), bins[rows].tobytes(),
                                    y[rows].astype("int32").tobytes(), w[rows].astype("int64").tobytes()))
                    if out:
                        yield pd.DataFrame(out, columns=names)

    return blocks.mapInPandas(dealt, _DEALT)


def _own_tasks(spark: SparkSession, n: int) -> list[int]:
    """Numbers that Spark's hash deals to tasks 0, 1, ... of ``n``."""
    found = spark.range(40 * n).select(F.col("id").cast("int").alias("id")).withColumn("task", F.pmod(F.hash("id"), F.lit(n)))
    first = {r["task"]: r["id"] for r in found.groupBy("task").agg(F.min("id").alias("id")).collect()}
    return [first.get(i, 40 * n + i) for i in range(n)]


def _whole_forests(
    learn: DataFrame, check: DataFrame, sizes: Mapping[int, int], test_sizes: Mapping[int, int], law: Law, block_cells: int, task_cells: int
) -> DataFrame:
    """``forest, label, n, p0, ...`` of forests whose cells fit a task: a task grows some trees of one forest and sums their shares."""
    spark = learn.sparkSession
    # a test cell costs about a tenth of one that is learned from
    cost = {f: sizes[f] + test_sizes[f] / 10 for f in sizes}
    per_task = sum(cost.values()) / (FOREST_TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    counts = {f: min(law.trees, math.ceil(n / per_task)) for f, n in cost.items()}
    units = sorted(((f, i) for f, c in counts.items() for i in range(c)), key=lambda u: (-cost[u[0]] / counts[u[0]], u))
    units = dict(zip(_own_tasks(spark, len(units)), units))
    own = F.create_map(*[v for f in counts for v in (F.lit(f), F.array(*[F.lit(u) for u, (g, _) in units.items() if g == f]))])

    def made(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        forest, first = units[int(key[0])]
        left, right = list(left.sort_values("block").itertuples()), list(right.sort_values("block").itertuples())
        parts = [_read(r, law.n_features) for r in left]
        bins, y, n = (np.concatenate(p) for p in zip(*parts))
        tests = np.concatenate([_read(r, law.n_features)[0] for r in right])
        total, grown = np.zeros((len(tests), law.n_classes)), 0
        for tree in range(first, law.trees, counts[forest]):
            w = np.concatenate([_bag(r, part[2], tree, law.seed) for r, part in zip(left, parts)])
            if w.any():
                total += _leaf_shares(grow(bins, y, w, 1, tree, law), tests)
                grown += 1
        ends = np.cumsum([r.size for r in right])
        return pd.DataFrame([(
            forest, r.block, grown, r.labels if first == 0 else b"", r.counts if first == 0 else b"", total[z - r.size : z].tobytes()
        ) for r, z in zip(right, ends)], columns=[c.split()[0] for c in _SUMS.split(", ")])

    def summed(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, "float64").reshape(-1, law.n_classes) for v in b["shares"])
        grown = int(b["grown"].sum())
        labels, n = np.frombuffer(b"".join(b["labels"]), "int32"), np.frombuffer(b"".join(b["counts"]), "int64")
        kept = slice(None) if grown else slice(0)
        return pd.DataFrame({"forest": np.int32(key[0]), "label": labels, "n": n} | {f"p{i}": total[:, i] / max(grown, 1) for i in range(law.n_classes)})[kept]

    # as many tasks as units, each with its own: two in one task would make others wait
    each = [d.withColumn("unit", F.explode(own[F.col("forest")])).repartition(len(units), "unit").groupBy("unit") for d in (learn, check)]
    sums = cut_lineage(each[0].cogroup(each[1]).applyInPandas(made, _SUMS))
    schema = "forest int, label int, n long, " + ", ".join(f"p{i} double" for i in range(law.n_classes))
    return sums.groupBy("forest", "block").applyInPandas(summed, schema)


def _parted_forests(
    learn: DataFrame, check: DataFrame, sizes: Mapping[int, int], test_sizes: Mapping[int, int], law: Law, block_cells: int, task_cells: int
) -> DataFrame:
    """``forest, label, n, p0, ...`` of forests whose cells do not fit a task: trees grow in parts, test cells meet each tree by join."""
    closed = split_tops(learn, sizes, law, task_cells)

    def grown(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        parts = [_read(r, law.n_features) for r in b.sort_values("block").itertuples()]
        made = grow(*[np.concatenate(p) for p in zip(*parts)], key[2], key[1], law)
        return pd.DataFrame([(*key, *[m.tobytes() for m in made])], columns=["forest", "tree", "leaf", "feature", "cut", "left", "prob"])

    def tested(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for m in left.itertuples():
            model = [np.frombuffer(v, t) for v, t in zip((m.feature, m.cut, m.left, m.prob), ("int32", "uint8", "int32", "float64"))]
            model[3] = model[3].reshape(-1, law.n_classes)
            for r in right.itertuples():
                bins, y, n = _read(r, law.n_features)
                found = {"forest": np.int32(r.forest), "block": np.int32(r.block), "place": np.frombuffer(r.places, "int32"), "label": y.astype("int32"), "n": n}
                p = _leaf_shares(model, bins)
                out.append(pd.DataFrame(found | {f"p{i}": p[:, i] for i in range(law.n_classes)}))
        return pd.concat(out) if out else pd.DataFrame(columns=["forest", "block", "place", "label", "n", *shares])

    # a fixed number of tasks: small shuffles would be put together, and with them the work of all trees
    shares = [f"p{i}" for i in range(law.n_classes)]
    keys = ["forest", "tree", "leaf"]
    spark = learn.sparkSession
    tasks = min(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, law.trees * len(sizes))
    models = _deal(learn, law, True, closed).repartition(tasks, *keys).groupBy(*keys).applyInPandas(grown, _GROWN)
    if closed:
        whole = [(*at, np.array([-1], "int32").tobytes(), b"\0", np.array([-1], "int32").tobytes(), (np.array(c) / sum(c)).tobytes()) for at, c in closed.items()]
        models = models.unionByName(spark.createDataFrame(whole, _GROWN))
    models = cut_lineage(models)
    # test cells of one tree are scored in parts that fit a task
    span = max(1, task_cells // block_cells)
    per = F.create_map(*[F.lit(v) for f, n in test_sizes.items() for v in (f, (math.ceil(n / block_cells) - 1) // span)])
    parts = models.withColumn("part", F.explode(F.sequence(F.lit(0), per[F.col("forest")])))
    rows = _deal(check, law, False).withColumn("part", F.floor(F.col("block") / span).cast("int"))
    each = [d.repartition(tasks, *keys, "part").groupBy(*keys, "part") for d in (parts, rows)]
    schema = "forest int, block int, place int, label int, n long, " + ", ".join(f"{p} double" for p in shares)
    scored = each[0].cogroup(each[1]).applyInPandas(tested, schema)
    means = scored.groupBy("forest", "block", "place", "label", "n").agg(*[F.avg(p).alias(p) for p in shares])
    return means.select("forest", "label", "n", *shares)


def forest_scores(
    train: DataFrame, test: DataFrame, cols: Sequence[str], trees: int = 100, seed: int = 42, max_depth: int = 30,
    block_cells: int = BLOCK_CELLS, task_cells: int = TASK_CELLS,
) -> DataFrame:
    """``forest, label, n, p0, p1, ...``: mean class shares over the trees of a forest, for ``n`` test rows of equal bins and label.

    Both sides have forest (its number), label (0, 1, ...) and ``cols``; each forest learns from its own rows. Nodes split by the
    Gini gain over a random subset of columns of the square root's size, with 32 bins, down to ``max_depth``.
    """
    whole = F.when(F.col("label") == F.floor("label"), F.col("label").cast("int")).otherwise(-1)  # -1: never predicted
    train, test = (cut_lineage(d.where(F.col("label").isNotNull()).select(
        F.col("forest").cast("int").alias("forest"), whole.alias("label"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols],
    )) for d in (train, test))
    least, most = train.agg(F.min("label"), F.max("label")).first()
    if least < 0:
        raise ValueError("training labels are 0, 1, 2, ...")
    law = Law(trees, seed, max_depth, len(cols), max(most + 1, 2))
    cuts = fit_cuts(train, cols)
    learn, sizes, _ = to_blocks(to_cells(train, cols, cuts), block_cells)
    check, test_sizes, _ = to_blocks(to_cells(test, cols, cuts), block_cells)
    shares = [f"p{i}" for i in range(law.n_classes)]
    fitting = [f for f in sizes if max(sizes[f], test_sizes.get(f, 0)) <= task_cells]
    found = None
    for forests, way in ((fitting, _whole_forests), ([f for f in sizes if f not in fitting], _parted_forests)):
        own = {f: n for f, n in test_sizes.items() if f in forests}
        if own:
            here = F.col("forest").isin(list(own))
            part = way(learn.where(here), check.where(here), {f: sizes[f] for f in own}, own, law, block_cells, task_cells)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = train.sparkSession.createDataFrame([], "forest int, label int, n long, " + ", ".join(f"{p} double" for p in shares))
    # rounded: the order in which trees are added up must not part equal scores
    return cut_lineage(found.select("forest", "label", "n", *[F.round(p, 12).alias(p) for p in shares]))
