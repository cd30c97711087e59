"""Exact nearest-neighbour distances between two vector tables.

Equal reference vectors are collapsed first, so a group of copies costs one row. Both sides are sorted along a space-filling
curve and cut into blocks of bounded size; a block is one row with its packed vectors, its centre, its radius and the box around
it. Blocks form a tree by their place on the curve. Pairs of nodes descend both trees by equi-joins: distance of centres less both
radii, or that of the boxes if it is more, is the least, distance of centres plus both radii the largest distance of a pair, and a
pair whose least distance exceeds the smallest largest one of its query node is dropped with all below it. What is left is compared
in rounds, nearest first: each round keeps the k smallest distances of every query, and the next one drops the pairs these rule
out. A reference block is shipped once per surviving pair; no vector is sent anywhere on its own, and a task holds one query block,
some reference blocks of ``HELD_BYTES`` in all and k distances per query. There, short runs of near queries visit the blocks held by
distance of boxes, and only queries that a block's box does not rule out are compared with it: in single precision first, whose
error is bounded, then exactly with the vectors that may be nearest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: Rows and bytes of a reference block; a query block has up to ``QUERY_SHARE`` times as many, fewer if tasks would be idle.
BLOCK_ROWS = 2048
BLOCK_BYTES = 2 << 20
QUERY_SHARE = 32
FANOUT = 16
#: Query blocks per core, at least, and tasks of a round per core, at most.
BLOCKS_PER_CORE, TASKS_PER_CORE = 4, 8
#: Reference blocks of a query block in the first round; each later round takes ``MORE_VISITS`` times as many.
FIRST_VISITS, MORE_VISITS = 16, 16
#: Reference blocks that one task compares with a query block in a row, and bytes of them held at once.
CHAIN = 64
HELD_BYTES = 32 << 20
#: Queries that visit the blocks held together.
RUN = 256
_SEQUENCE_BITS = 20
_SLACK = 1e-9


def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype="float64") for v in series]) if len(series) else np.empty((0, 0))


def k_smallest(q: np.ndarray, r: np.ndarray, mult: np.ndarray, k: int, skip_self: np.ndarray) -> np.ndarray:
    """The k smallest distances of each query row, copies counted by ``mult``, infinite where there are fewer.

    A row of ``skip_self`` leaves one equal vector out. Candidates come from the expanded square; their distances are then exact.
    """
    out = np.full((len(q), k), np.inf)
    m = min(len(r), k + 8)
    r2 = (r * r).sum(1)
    plain = bool((mult == 1).all()) and not skip_self.any()
    for s in range(0, len(q), 512):
        part = q[s : s + 512]
        d2 = (part * part).sum(1)[:, None] + r2[None, :] - 2.0 * part @ r.T
        idx = np.argpartition(d2, m - 1, axis=1)[:, :m]
        exact = np.sqrt(((part[:, None, :] - r[idx]) ** 2).sum(2))
        if plain:
            out[s : s + 512, : min(k, m)] = np.sort(exact, axis=1)[:, :k]
            continue
        order = np.argsort(exact, axis=1, kind="stable")
        for i in range(len(part)):
            at, owed = 0, bool(skip_self[s + i])
            for j in order[i]:
                copies = int(mult[idx[i, j]])
                if owed and exact[i, j] == 0.0:
                    copies, owed = copies - 1, False
                take = min(copies, k - at)
                out[s + i, at : at + take] = exact[i, j]
                at += take
                if at >= k:
                    break
    return out


# ---- blocks -----------------------------------------------------------------------------------------------------------------
def _moments(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, and mean and standard deviation of each dimension; tasks hand on one row per dimension."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, ss = 0, 0.0, 0.0
        for b in batches:
            if len(b):
                x = _matrix(b["vec"])
                n, s, ss = n + len(x), s + x.sum(0), ss + (x * x).sum(0)
        if n:
            yield pd.DataFrame({"dim": np.arange(len(s)), "n": n, "s": s, "ss": ss})

    rows = vectors.select("vec").mapInPandas(partial, "dim int, n long, s double, ss double").groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")
    ).orderBy("dim").collect()
    if not rows:
        return 0, np.empty(0), np.empty(0)
    n, s, ss = rows[0]["n"], np.array([r["s"] for r in rows]), np.array([r["ss"] for r in rows])
    return n, s / n, np.sqrt(np.maximum(ss / n - (s / n) ** 2, 0.0))


def curve_key(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Place on the curve: interleaved leading bits of the dimensions that vary most."""
    dims = np.argsort(-sd, kind="stable")[:15]
    bits = 60 // max(len(dims), 1)
    width = np.where(sd[dims] > 0, 8.0 * sd[dims], 1.0)
    cell = np.clip((x[:, dims] - mean[dims]) / width + 0.5, 0.0, 1.0 - 1e-12)
    cell = (cell * 2.0**bits).astype(np.int64)
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for j in range(len(dims)):
            key = (key << 1) | ((cell[:, j] >> b) & 1)
    return key


def parted(x: np.ndarray, rows: int) -> Iterator[np.ndarray]:
    """Positions of the rows of each block: cut, while too large, at the mean of the dimension whose halves lie furthest apart."""
    stack = [np.arange(len(x))]
    while stack:
        at = stack.pop()
        if len(at) <= rows:
            yield at
            continue
        own, n = x[at], len(at)
        above = own > own.mean(0)
        up, total, upper = above.sum(0), own.sum(0), np.where(above, own, 0.0).sum(0)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            gain = (upper / up - (total - upper) / (n - up)) ** 2 * up * (n - up)
        gain = np.where((np.minimum(up, n - up) * FANOUT >= n) & np.isfinite(gain), gain, 0.0)
        dim = int(gain.argmax())
        if gain[dim] > 0:
            side = above[:, dim]
        else:  # no cut leaves enough rows on both sides
            dim = int((own.max(0) - own.min(0)).argmax())
            side = np.zeros(n, bool)
            side[np.argsort(own[:, dim], kind="stable")[n // 2 :]] = True
        stack += [at[side], at[~side]]


_BLOCK = "block long, n int, copies long, centre array<double>, radius double, lo array<double>, hi array<double>, data binary, extra binary"


def _blocks(
    df: DataFrame, n: int, rows: int, mean: np.ndarray, sd: np.ndarray, extra: str, kind: str, ids: str | None = None, chunk: int = 0
) -> DataFrame:
    """Rows (vec, ``extra`` and maybe ``ids``) as a written table of blocks of at most ``rows`` vectors, cut from ``chunk`` at a time.

    ``extra`` is packed with numpy type ``kind``. A block's number is its range partition and its place there. With ``ids``, rows
    of a block that lie near each other follow each other.
    """
    chunk = chunk or rows * FANOUT
    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    keep = [c for c in (ids, extra) if c]

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(key=curve_key(_matrix(b["vec"]), mean, sd))

    def blocks(held: pd.DataFrame, part: int, number: int) -> Iterator[pd.DataFrame]:
        every = _matrix(held["vec"])
        for k, at in enumerate(parted(every, rows)):
            if ids:
                at = at[np.concatenate(list(parted(every[at], RUN)))]
            x, packed = every[at], held[extra].to_numpy()[at].astype(kind)
            centre = x.mean(0)
            row = {
                "block": (part << _SEQUENCE_BITS) | (number + k), "n": len(x), "copies": int(packed.sum()) if extra == "mult" else len(x),
                "centre": centre, "radius": float(np.sqrt(((x - centre) ** 2).sum(1).max())), "lo": x.min(0), "hi": x.max(0),
                "data": x.tobytes(), "extra": packed.tobytes(),
            }
            yield pd.DataFrame([row | ({"ids": held[ids].iloc[at].tolist()} if ids else {})])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, held, count = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            held.append(b)
            count += len(b)
            if count >= chunk:
                for out in blocks(pd.concat(held, ignore_index=True), part, number):
                    number += 1
                    yield out
                held, count = [], 0
        if count:
            yield from blocks(pd.concat(held, ignore_index=True), part, number)

    parts = max(1, math.ceil(n / chunk))
    with_key = df.mapInPandas(keyed, f"{schema}, key long").withColumn("tie", F.xxhash64(*[c for c in df.columns]))
    placed = with_key.repartitionByRange(parts, "key", "tie") if parts > 1 else with_key.repartition(1)
    out = placed.sortWithinPartitions("key", "tie").select("vec", *keep)
    return cut_lineage(out.mapInPandas(pack, _BLOCK + (f", ids array<{dict(df.dtypes)[ids]}>" if ids else "")))


def _tree(blocks: DataFrame) -> list[DataFrame]:
    """Levels of nodes (node, parent, copies, centre, radius, lo, hi) from the blocks up, the last of at most ``FANOUT`` nodes."""

    def merge(nodes: pd.DataFrame) -> pd.DataFrame:
        c, w = _matrix(nodes["centre"]), nodes["copies"].to_numpy()
        centre = (c * w[:, None]).sum(0) / max(w.sum(), 1)
        reach = np.sqrt(((c - centre) ** 2).sum(1)) + nodes["radius"].to_numpy()
        lo, hi = _matrix(nodes["lo"]).min(0), _matrix(nodes["hi"]).max(0)
        return pd.DataFrame([{"node": nodes["parent"].iloc[0], "copies": int(w.sum()), "centre": centre, "radius": float(reach.max()), "lo": lo, "hi": hi}])

    level = blocks.select(
        F.col("block").alias("node"), F.shiftright("block", _SEQUENCE_BITS).alias("parent"), "copies", "centre", "radius", "lo", "hi"
    )
    levels, count = [level], blocks.select("block").count()
    while count > FANOUT:
        up = level.groupBy("parent").applyInPandas(
            merge, "node long, copies long, centre array<double>, radius double, lo array<double>, hi array<double>"
        )
        level = cut_lineage(up.withColumn("parent", F.shiftright("node", 4)))
        levels.append(level)
        count = level.count()
    return levels


def _bounded(pairs: DataFrame, q: DataFrame, r: DataFrame, need: int) -> DataFrame:
    """Pairs (q, r) of nodes that their bounds cannot rule out, with the least distance and that of the centres."""
    a = q.select(F.col("node").alias("q"), F.col("centre").alias("qc"), F.col("radius").alias("qr"), F.col("lo").alias("ql"), F.col("hi").alias("qh"))
    b = r.select(F.col("node").alias("r"), F.col("centre").alias("rc"), F.col("radius").alias("rr"), F.col("lo").alias("rl"), F.col("hi").alias("rh"), "copies")
    long = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    apart = long(F.zip_with("qc", "rc", lambda x, y: x - y))
    sides = F.zip_with(F.zip_with("rl", "qh", lambda x, y: x - y), F.zip_with("ql", "rh", lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    gap = long(F.transform(sides, lambda x: F.greatest(x, F.lit(0.0))))
    met = pairs.join(a, "q").join(b, "r").select(
        "q", "r", apart.alias("apart"), (F.col("qr") + F.col("rr")).alias("reach"), gap.alias("gap"), "copies"
    )
    far = F.min(F.when(F.col("copies") >= need, F.col("apart") + F.col("reach"))).over(Window.partitionBy("q"))
    kept = met.select("q", "r", "apart", F.greatest(F.col("apart") - F.col("reach"), "gap").alias("least"), far.alias("far"))
    return kept.where(F.col("far").isNull() | (F.col("least") <= F.col("far") * (1 + _SLACK) + _SLACK)).select("q", "r", "least", "apart")


def _surviving(qtree: list[DataFrame], rtree: list[DataFrame], need: int) -> DataFrame:
    """Pairs of blocks after the descent of both trees."""
    i, j = len(qtree) - 1, len(rtree) - 1
    tops = [row["node"] for row in rtree[j].select("node").collect()]  # at most FANOUT
    pairs = qtree[i].select(F.col("node").alias("q"), F.explode(F.array(*[F.lit(t) for t in tops])).alias("r"))
    pairs = _bounded(pairs, qtree[i], rtree[j], need)
    while i or j:
        if i:
            i -= 1
            pairs = pairs.join(qtree[i].select(F.col("node").alias("__q"), F.col("parent").alias("q")), "q").select(F.col("__q").alias("q"), "r")
        if j:
            j -= 1
            pairs = pairs.join(rtree[j].select(F.col("node").alias("__r"), F.col("parent").alias("r")), "r").select("q", F.col("__r").alias("r"))
        pairs = _bounded(pairs.select("q", "r"), qtree[i], rtree[j], need)
    return pairs


# ---- rounds -----------------------------------------------------------------------------------------------------------------
_STATE = "q long, best binary, bound double"


def _state(q: int, best: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"q": [q], "best": [best.tobytes()], "bound": [float(best[:, -1].max())]})


class _Refs:
    """A reference block as it is compared: exactly, and as the single precision factor of ``|r|^2 - 2 q r`` about its centre."""

    def __init__(self, row, d: int):
        self.r, self.mult = np.frombuffer(row.data, "float64").reshape(-1, d), np.frombuffer(row.extra, "int64")
        self.centre, self.radius = np.asarray(row.centre), row.radius
        z = self.r - self.centre
        with np.errstate(over="ignore", invalid="ignore"):
            self.factor = np.ascontiguousarray(np.concatenate([z, (z * z).sum(1)[:, None]], axis=1).astype("float32").T)


def _closer(q: np.ndarray, best: np.ndarray, worst: np.ndarray, skip: np.ndarray, refs: _Refs) -> None:
    """Take the distances to ``refs`` that are among the k smallest up to ``worst`` into ``best``.

    The error of a single precision product is at most ``slack``, so vectors that may be nearest are told by twice that.
    """
    k = best.shape[1]
    with np.errstate(over="ignore", invalid="ignore"):
        z = q - refs.centre
        zz = np.einsum("ij,ij->i", z, z)
        reach = (np.sqrt(zz) + refs.radius) ** 2
    open_ = np.arange(len(q))
    if reach.max() < 1e30:  # never so with a value that is no number
        factor = np.empty((len(z), z.shape[1] + 1), "float32")
        factor[:, :-1], factor[:, -1] = -2 * z, 1
        near = factor @ refs.factor
        least, slack = near.min(1), (z.shape[1] + 8) * 2.0**-23 * reach
        open_ = np.flatnonzero(least + zz - slack <= worst * worst)
        if k == 1:
            one = open_[~skip[open_]]
            i, j = np.nonzero(near[one] <= (least[one] + 2 * slack[one])[:, None])
            np.minimum.at(best[:, 0], one[i], np.sqrt(((q[one[i]] - refs.r[j]) ** 2).sum(1)))
            open_ = open_[skip[open_]]
    if len(open_):
        found = k_smallest(q[open_], refs.r, refs.mult, k, skip[open_])
        best[open_] = np.sort(np.concatenate([best[open_], found], axis=1), axis=1)[:, :k]


def _visit(q: np.ndarray, best: np.ndarray, limit: np.ndarray, skip: np.ndarray, held: list[_Refs], lo: np.ndarray, hi: np.ndarray) -> None:
    """Compare runs of queries with the blocks held (boxes ``lo`` to ``hi``), nearest first; ``best`` is changed in place."""
    for s in range(0, len(q), RUN):
        x, own, top, left = q[s : s + RUN], best[s : s + RUN], limit[s : s + RUN], skip[s : s + RUN]
        gap = np.sqrt((np.maximum(np.maximum(lo - x.max(0), x.min(0) - hi), 0.0) ** 2).sum(1))
        for j in np.argsort(gap, kind="stable"):
            worst = np.minimum(own[:, -1], top) * (1 + _SLACK) + _SLACK
            if gap[j] > worst.max():
                break
            out = np.maximum(np.maximum(lo[j] - x, x - hi[j]), 0.0)
            near = np.flatnonzero(np.sqrt(np.einsum("ij,ij->i", out, out)) <= worst)
            if len(near):
                part = own[near]
                _closer(x[near], part, worst[near], left[near], held[j])
                own[near] = part


def _compare(batches: Iterator[pd.DataFrame], k: int, d: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by (q, part, kind, least): a query block, then its reference blocks, nearest first.

    Gives the k smallest of these distances alone; what earlier rounds found only limits the search.
    """
    key, q, best, skip, limit, held, size = None, None, None, None, None, [], 0

    def visit() -> None:
        if held:
            boxes = [_matrix(pd.Series([getattr(row, side) for row in held])) for side in ("lo", "hi")]
            _visit(q, best, limit, skip, [_Refs(row, d) for row in held], *boxes)
            held.clear()

    for b in batches:
        for row in b.itertuples(index=False):
            if (row.q, row.part) != key:
                if key is not None:
                    visit()
                    yield _state(key[0], best)
                key, size = (row.q, row.part), 0
                q = np.frombuffer(row.data, "float64").reshape(-1, d)
                skip = np.frombuffer(row.extra, "bool")
                best = np.full((len(q), k), np.inf)
                limit = best[:, -1].copy() if row.best is None else np.frombuffer(row.best, "float64").reshape(-1, k)[:, -1]
                continue
            if row.least > (np.minimum(best[:, -1], limit) * (1 + _SLACK) + _SLACK).max():
                continue
            held.append(row)
            size += len(row.data)
            if size >= HELD_BYTES:
                visit()
                size = 0
    if key is not None:
        visit()
        yield _state(key[0], best)


def _merge(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by q to one row per q with the k smallest of all its rows."""
    key, best = None, None
    for b in batches:
        for row in b.itertuples(index=False):
            own = np.frombuffer(row.best, "float64").reshape(-1, k)
            if row.q != key:
                if key is not None:
                    yield _state(key, best)
                key, best = row.q, own
            else:
                best = np.sort(np.concatenate([best, own], axis=1), axis=1)[:, :k]
    if key is not None:
        yield _state(key, best)


def nearest_distances(
    queries: DataFrame,
    refs: DataFrame,
    query_id: str,
    vector: str = "vec",
    k: int = 1,
    skip_self: str | None = None,
    block_rows: int = BLOCK_ROWS,
    chain: int = CHAIN,
) -> DataFrame:
    """``query_id, distances`` with the k smallest Euclidean distances, ascending; fewer where there are fewer references.

    ``skip_self`` names a boolean query column; true rows are themselves among
    the references and leave one equal vector out.
    """
    skip = F.col(skip_self) if skip_self else F.lit(False)
    qtype = dict(queries.dtypes)[query_id]
    qs = cut_lineage(queries.select(F.col(query_id).alias("qid"), F.col(vector).cast("array<double>").alias("vec"), skip.alias("skip")))
    rs = cut_lineage(refs.select(F.col(vector).cast("array<double>").alias("vec")).groupBy("vec").agg(F.count(F.lit(1)).alias("mult")))
    n, mean, sd = _moments(rs)
    if not n:
        raise ValueError("no reference rows")
    n_queries = qs.count()
    if not n_queries:
        return qs.select(F.col("qid").alias(query_id), F.array().cast("array<double>").alias("distances"))
    d = len(mean)
    rows = max(1, min(block_rows, BLOCK_BYTES // (8 * max(d, 1))))
    cores = qs.sparkSession.sparkContext.defaultParallelism
    qrows = min(max(rows, math.ceil(n_queries / (BLOCKS_PER_CORE * cores))), rows * QUERY_SHARE)
    tasks = min(TASKS_PER_CORE * cores, BLOCKS_PER_CORE * math.ceil(n_queries / qrows))
    qblocks = _blocks(qs, n_queries, qrows, mean, sd, "skip", "bool", "qid", rows * QUERY_SHARE)
    rblocks = _blocks(rs, n, rows, mean, sd, "mult", "int64", chunk=rows * QUERY_SHARE)
    near = _surviving(_tree(qblocks), _tree(rblocks), k + bool(skip_self))

    def ranked(pairs: DataFrame) -> DataFrame:
        order = Window.partitionBy("q").orderBy("least", "apart", "r")
        return cut_lineage(pairs.select("q", "r", "least", "apart", F.row_number().over(order).alias("rank")))

    pairs, state, visits = ranked(near), None, FIRST_VISITS
    while True:
        state = _round(qblocks, rblocks, pairs.where(F.col("rank") <= visits), state, k, d, chain, tasks)
        if not pairs.where(F.col("rank") > visits).limit(1).count():
            break
        left = pairs.where(F.col("rank") > visits).drop("rank").join(state.select("q", "bound"), "q")
        pairs = ranked(left.where(F.col("least") <= F.col("bound") * (1 + _SLACK) + _SLACK))
        visits *= MORE_VISITS
        if not pairs.limit(1).count():
            break

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                best = np.frombuffer(row.best, "float64").reshape(-1, k)
                yield pd.DataFrame({"qid": row.ids, "distances": [list(x[np.isfinite(x)]) for x in best]})

    found = qblocks.select(F.col("block").alias("q"), "ids").join(state, "q").select("ids", "best")
    return found.mapInPandas(rows_of, f"qid {qtype}, distances array<double>").select(F.col("qid").alias(query_id), "distances")


def _round(
    qblocks: DataFrame, rblocks: DataFrame, pairs: DataFrame, state: DataFrame | None, k: int, d: int, chain: int, tasks: int
) -> DataFrame:
    """The state (q, best, bound) of all query blocks after comparing ``pairs``."""
    parted = pairs.select("q", "r", "least", F.floor((F.col("rank") - 1) / chain).cast("int").alias("part"))
    q = qblocks.select(F.col("block").alias("q"), "data", "extra")
    q = q.withColumn("best", F.lit(None).cast("binary")) if state is None else q.join(state.select("q", "best"), "q", "left")
    heads = parted.select("q", "part").distinct().join(q, "q").select(
        "q", "part", F.lit(0).alias("kind"), F.lit(-1.0).alias("least"), "data", "extra", "best",
        F.lit(None).cast("array<double>").alias("centre"), F.lit(0.0).alias("radius"),
        *[F.lit(None).cast("array<double>").alias(c) for c in ("lo", "hi")],
    )
    tails = parted.join(rblocks.withColumnRenamed("block", "r"), "r").select(
        "q", "part", F.lit(1).alias("kind"), "least", "data", "extra", F.lit(None).cast("binary").alias("best"), "centre", "radius", "lo", "hi"
    )
    # a fixed number of tasks: small shuffles would be put together, and with them the work of all blocks
    rows = heads.unionAll(tails).repartition(tasks, "q", "part").sortWithinPartitions("q", "part", "kind", "least")
    found = rows.mapInPandas(lambda b: _compare(b, k, d), _STATE)
    every = found if state is None else found.unionAll(state)
    return cut_lineage(every.repartition("q").sortWithinPartitions("q").mapInPandas(lambda b: _merge(b, k), _STATE))


def as_vector(cols: Sequence[str]) -> Column:
    """Columns as one array, NULL read as 0."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
