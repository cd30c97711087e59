"""Ranking, running sums and quantiles that never put one group into one task.

A plain ``Window.partitionBy(key)`` or an exact-percentile buffer holds a whole
group in one task, which fails when one key owns a third of the rows. The
operators here first collapse equal values (map-side combine), then cut every
column into value blocks of about equal size. A block is the unit of sorting;
block totals, at most ``groups x blocks`` rows, carry the offsets between them.

Inputs counted to have no more rows than one block take the plain form: there
one task can hold any group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import hash_uniform
from tidemark.session import cut_lineage

HOT_ROWS = 1_000_000
BLOCK_ROWS = 4_000_000
FIRST_BLOCKS = 64


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; keeps the left key columns."""
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"__r_{k}")
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def first_by(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank_col: str | None = None
) -> DataFrame:
    """First ``n`` rows per key. Spark plans a group limit below the shuffle, so
    a hot key sends at most ``n`` rows per map task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    name = rank_col or "__rn"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return out if rank_col else out.drop(name)


# ---- value blocks ---------------------------------------------------------
Edges = Mapping[str, Sequence[float]]


def fit_blocks(
    df: DataFrame, cols: Sequence[str], n_blocks: int | None = None, block_rows: int = BLOCK_ROWS
) -> Edges | None:
    """Approximate quantile edges for all columns, or None for an input counted
    to fit one block. A block has about ``block_rows`` rows at any size of the
    input; one scan counts and finds edges, a second is made only where more
    blocks are needed. Results never depend on where edges fall."""

    def scan(n: int):
        probs = [i / n for i in range(1, n)]
        return df.agg(
            F.count(F.lit(1)).alias("__rows"),
            *[F.percentile_approx(F.col(c).cast("double"), probs, 10 * n).alias(c) for c in cols],
        ).first()

    n = n_blocks or FIRST_BLOCKS
    row = scan(n)
    if n_blocks is None:
        wanted = math.ceil(row["__rows"] / block_rows)
        if wanted <= 1:
            return None
        if wanted > n:
            row = scan(wanted)
    return {c: sorted({float(v) for v in (row[c] or []) if v == v}) for c in cols}


def with_blocks(df: DataFrame, cols: Sequence[str], edges: Edges | None) -> DataFrame:
    """Add ``<col>__num`` (as double) and ``<col>__block``."""
    out = df.select("*", *[F.col(c).cast("double").alias(f"{c}__num") for c in cols])
    if edges is None:
        return out.select("*", *[F.lit(0).alias(f"{c}__block") for c in cols])
    inf = float("inf")
    splits = [[-inf, *(e for e in edges[c] if abs(e) != inf), inf] for c in cols]
    bucketizer = Bucketizer(
        splitsArray=[s if len(s) > 2 else [-inf, 0.0, inf] for s in splits],
        inputCols=[f"{c}__num" for c in cols],
        outputCols=[f"{c}__block" for c in cols],
        handleInvalid="keep",
    )
    return bucketizer.transform(out)


def value_sums(
    df: DataFrame,
    group: Sequence[str],
    cols: Sequence[str],
    edges: Edges | None,
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per (group, variable, distinct value) with summed measures.

    All columns are unpivoted in the same scan. NULL and NaN values are left out.
    """
    sums = dict(sums or {"cnt": F.lit(1)})
    blocked = with_blocks(df, cols, edges)
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("variable"),
                F.col(f"{c}__block").cast("int").alias("block"),
                F.col(f"{c}__num").alias("value"),
            )
            for c in cols
        ]
    )
    long = blocked.select(
        *group, *[m.cast("long").alias(f"__{k}") for k, m in sums.items()], F.explode(entries).alias("e")
    ).select(*group, *[f"__{k}" for k in sums], "e.*")
    return (
        long.where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy(*group, "variable", "block", "value")
        .agg(*[F.sum(f"__{k}").alias(k) for k in sums])
    )


def _block_offsets(counts: DataFrame, part: Sequence[str], sums: Sequence[str]) -> DataFrame:
    per_block = counts.groupBy(*part, "block").agg(*[F.sum(s).alias(f"{s}_block") for s in sums])
    before = Window.partitionBy(*part).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*part)
    return per_block.select(
        *part,
        "block",
        *[F.col(f"{s}_block") for s in sums],
        *[F.coalesce(F.sum(f"{s}_block").over(before), F.lit(0)).alias(f"{s}_offset") for s in sums],
        *[F.sum(f"{s}_block").over(whole).alias(f"{s}_total") for s in sums],
    )


def running_sums(counts: DataFrame, part: Sequence[str], sums: Sequence[str], blocked: bool = True) -> DataFrame:
    """Add ``<s>_before`` (sum over smaller values) and ``<s>_total`` per part."""
    if not blocked:
        order = Window.partitionBy(*part).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        return counts.select(
            "*",
            *[F.coalesce(F.sum(s).over(order), F.lit(0)).alias(f"{s}_before") for s in sums],
            *[F.sum(s).over(Window.partitionBy(*part)).alias(f"{s}_total") for s in sums],
        )
    offsets = _block_offsets(counts, part, sums).drop(*[f"{s}_block" for s in sums])
    joined = null_safe_join(counts, offsets, [*part, "block"])
    inside = (
        Window.partitionBy(*part, "block").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    )
    out = joined.select(
        "*",
        *[
            (F.col(f"{s}_offset") + F.coalesce(F.sum(s).over(inside), F.lit(0))).alias(f"{s}_before")
            for s in sums
        ],
    )
    return out.drop(*[f"{s}_offset" for s in sums])


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    group: Sequence[str] = (),
    n_blocks: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Exact, linearly interpolated quantiles per (group, variable).

    A row counts ``weight`` times (once by default). Returns ``group..., variable, n, q0, q1, ...`` in the order of ``probs``.
    Only the blocks that hold a wanted rank are sorted.
    """
    edges = fit_blocks(df, cols, n_blocks)
    part = [*group, "variable"]
    counts = value_sums(df, group, cols, edges, {"cnt": F.col(weight)} if weight else None)
    if edges is None:
        ranked = running_sums(counts, part, ["cnt"], False).withColumnRenamed("cnt_before", "first")
    else:
        offsets = _block_offsets(counts, part, ["cnt"])
        wanted = None
        for p in probs:
            pos = F.lit(float(p)) * (F.col("cnt_total") - 1)
            for rank in (F.floor(pos), F.ceil(pos)):
                hit = (rank >= F.col("cnt_offset")) & (rank < F.col("cnt_offset") + F.col("cnt_block"))
                wanted = hit if wanted is None else wanted | hit
        picked = null_safe_join(counts, offsets.where(wanted), [*part, "block"])
        inside = (
            Window.partitionBy(*part, "block").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        )
        ranked = picked.withColumn(
            "first", F.col("cnt_offset") + F.coalesce(F.sum("cnt").over(inside), F.lit(0))
        )
    aggs = [F.max("cnt_total").alias("n")]
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("cnt_total") - 1)
        for tag, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            here = (rank >= F.col("first")) & (rank < F.col("first") + F.col("cnt"))
            aggs.append(F.max(F.when(here, F.col("value"))).alias(f"__{tag}{i}"))
    res = ranked.groupBy(*part).agg(*aggs)
    outs = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        outs.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(f"q{i}"))
    return res.select(*part, "n", *outs)


# ---- hot groups -----------------------------------------------------------
def hot_groups(
    df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, rate: float = 0.01
) -> DataFrame | None:
    """Keys that own about ``hot_rows`` rows or more, or None when there are none.

    Hot keys are found on a sample, which only decides *how* a group is computed:
    both ways are exact.
    """
    sample = df.select(*keys) if rate >= 1.0 else df.select(*keys).sample(rate, 7)
    hot = (
        sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") >= max(1.0, hot_rows * rate / 2))
        .drop("__n")
    )
    hot = cut_lineage(hot)  # one fixed list for both branches
    return None if hot.isEmpty() else hot


def split_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary groups, rows of hot groups)."""
    return null_safe_join(df, hot, keys, "left_anti"), null_safe_join(df, hot, keys, "left_semi")


# ---- exact random ranks ---------------------------------------------------
def hash_rank(
    df: DataFrame, ids: Sequence[str], seed: int | str, strata: Sequence[str] = (), n_blocks: int | None = None
) -> DataFrame:
    """Add ``rank`` (1-based, random but reproducible order within each stratum)
    and ``stratum_rows``. Hash values are uniform, so equal slices of the hash
    range are equal blocks and no stratum is ever sorted as a whole."""
    n = n_blocks or max(4, math.ceil(df.count() / BLOCK_ROWS))
    u = hash_uniform(seed, *[F.col(c) for c in ids])
    blocked = df.withColumn("__u", u).withColumn("block", F.floor(F.col("__u") * n).cast("int"))
    counts = blocked.groupBy(*strata, "block").agg(F.count(F.lit(1)).alias("cnt"))
    offsets = _block_offsets(counts, list(strata), ["cnt"]).drop("cnt_block")
    joined = null_safe_join(blocked, offsets, [*strata, "block"])
    w = Window.partitionBy(*strata, "block").orderBy("__u", *ids)
    return joined.select(
        *df.columns,
        (F.row_number().over(w) + F.col("cnt_offset")).cast("long").alias("rank"),
        F.col("cnt_total").alias("stratum_rows"),
    )


#: Slices of the hash range in one step of the selection.
SLICES = 4096


def hash_cuts(df: DataFrame, ids: Sequence[str], seed: int | str, strata: Sequence[str], wanted: Callable[[Column], Sequence[Column]]) -> DataFrame:
    """``strata..., cuts``: for each number of rows in ``wanted(rows of the stratum)`` the last row in the order of
    ``hash_rank`` that is among so many, as a struct (u, ids); null for none.

    Radix selection: two counts of ever finer slices of the hash range lead to the few rows around each cut, and only these are
    sorted. Rows are read narrow, and what is shuffled are counts. Rows with the same ids are on the same side of every cut.
    """
    narrow = cut_lineage(df.select(*strata, *[c for c in ids if c not in strata]))
    u = hash_uniform(seed, *[F.col(c) for c in ids])
    place = narrow.withColumn("__u", u)
    place = place.withColumn("__a", F.floor(F.col("__u") * SLICES)).withColumn("__b", F.floor(F.col("__u") * (SLICES * SLICES)))

    def found(counts: DataFrame, part: Sequence[str], slice_: str, targets: Column) -> DataFrame:
        """Per target the slice that holds it and how many rows of the slice are still wanted."""
        order = Window.partitionBy(*part).orderBy(slice_).rowsBetween(Window.unboundedPreceding, 0)
        running = counts.withColumn("__upto", F.sum("__n").over(order)).withColumn("__rows", F.sum("__n").over(Window.partitionBy(*part)))
        each = running.withColumn("__t", F.explode(targets))
        hit = (F.col("__t.rest") > F.col("__upto") - F.col("__n")) & (F.col("__t.rest") <= F.col("__upto"))
        rest = F.col("__t.rest") - F.col("__upto") + F.col("__n")
        return each.where(hit).select(*strata, F.col("__t.cut").alias("__cut"), slice_, rest.cast("long").alias("__rest"))

    entries = F.array(*[F.struct(F.lit(i).alias("cut"), w.cast("long").alias("rest")) for i, w in enumerate(wanted(F.col("__rows")))])
    coarse = place.groupBy(*strata, "__a").agg(F.count(F.lit(1)).alias("__n"))
    first = cut_lineage(found(coarse, strata, "__a", entries))
    inside = null_safe_join(place, first.withColumnRenamed("__rest", "__left"), [*strata, "__a"])
    fine = inside.groupBy(*strata, "__cut", "__left", "__b").agg(F.count(F.lit(1)).alias("__n"))
    target = F.array(F.struct(F.col("__cut").alias("cut"), F.col("__left").alias("rest")))
    second = cut_lineage(found(fine, [*strata, "__cut"], "__b", target))
    near = null_safe_join(place, second, [*strata, "__b"])
    last = Window.partitionBy(*strata, "__cut").orderBy("__u", *ids)
    row = F.struct(F.col("__u").alias("u"), *[F.col(c).alias(f"i{k}") for k, c in enumerate(ids)])
    edge = near.withColumn("__k", F.row_number().over(last)).where("__k = __rest").select(*strata, "__cut", row.alias("__row"))
    n = len(wanted(F.col("__rows")))
    cuts = edge.groupBy(*strata).agg(*[F.max(F.when(F.col("__cut") == i, F.col("__row"))).alias(f"cut{i}") for i in range(n)])
    return cut_lineage(cuts)


def upto_cut(cut: str, ids: Sequence[str], seed: int | str) -> Column:
    """Is the row at or before the cut? False without one."""
    row = F.struct(hash_uniform(seed, *[F.col(c) for c in ids]).alias("u"), *[F.col(c).alias(f"i{k}") for k, c in enumerate(ids)])
    return F.coalesce(row <= F.col(cut), F.lit(False))
