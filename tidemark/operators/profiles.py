"""Descriptive tables: profiles, Table 1, rates, histograms, correlations."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.formatting import fixed
from tidemark.operators.prep import category_counts
from tidemark.operators.skew import null_safe_join, quantiles


def _entries(rows: Sequence[Column]) -> Column:
    return F.explode(F.array(*rows)).alias("e")


def numeric_profile(df: DataFrame, cols: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """N, missing, mean, sd, min, q1, median, q3, max per numeric column."""
    def num(c):
        v = F.col(c).cast("double")
        return F.when(~F.isnan(v), v)

    wide = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count(num(c)).alias(f"{c}__n") for c in cols],
        *[F.avg(num(c)).alias(f"{c}__mean") for c in cols],
        *[F.stddev_samp(num(c)).alias(f"{c}__sd") for c in cols],
        *[F.min(num(c)).alias(f"{c}__min") for c in cols],
        *[F.max(num(c)).alias(f"{c}__max") for c in cols],
    )
    long = wide.select(
        *group,
        "__rows",
        _entries(
            [
                F.struct(
                    F.lit(c).alias("variable"),
                    *[F.col(f"{c}__{s}").alias(s) for s in ("n", "mean", "sd", "min", "max")],
                )
                for c in cols
            ]
        ),
    ).select(*group, "__rows", "e.*")
    q = quantiles(df, cols, [0.25, 0.5, 0.75], group).drop("n")
    return null_safe_join(long, q, [*group, "variable"], "left").select(
        *group,
        "variable",
        "n",
        (F.col("__rows") - F.col("n")).alias("missing"),
        (F.lit(100.0) * (F.col("__rows") - F.col("n")) / F.col("__rows")).alias("missing_pct"),
        "mean",
        "sd",
        "min",
        F.col("q0").alias("q1"),
        F.col("q1").alias("median"),
        F.col("q2").alias("q3"),
        "max",
    )


def category_profile(df: DataFrame, cols: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Count and share of all rows per category; NULL is not a category."""
    counts = category_counts(df, cols, group)
    totals = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__rows"))
    if group:
        joined = null_safe_join(counts, totals, group)
    else:
        joined = counts.withColumn("__rows", F.lit(totals.first()[0]))
    return joined.where(F.col("category").isNotNull()).select(
        *group, "variable", "category", "n", (F.lit(100.0) * F.col("n") / F.col("__rows")).alias("pct")
    )


def binary_profile(df: DataFrame, cols: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Number and share of positive rows per 0/1 column."""
    wide = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("__rows"), *[F.sum(F.col(c).cast("long")).alias(c) for c in cols]
    )
    return wide.select(
        *group,
        "__rows",
        _entries([F.struct(F.lit(c).alias("variable"), F.coalesce(F.col(c), F.lit(0)).alias("n")) for c in cols]),
    ).select(*group, "e.*", (F.lit(100.0) * F.col("e.n") / F.col("__rows")).alias("pct"))


def missing_rates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return wide.select(
        _entries([F.struct(F.lit(c).alias("variable"), (F.col(c) * 100.0).alias("missing_pct")) for c in cols])
    ).select("e.*")


def top_categories(df: DataFrame, col: str, n: int = 8) -> DataFrame:
    """Most frequent values, ties by value."""
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(F.col(col).alias("category"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("category"))
        .limit(n)
    )


def group_mean(df: DataFrame, group: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in cols])


def binned_rate(df: DataFrame, bin_expr: Column, flag: str) -> DataFrame:
    """Rate of a 0/1 flag per bin with the half width of its 95 % Wald interval."""
    agg = (
        df.select(bin_expr.alias("bin"), F.col(flag).cast("double").alias("f"))
        .where(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("f"), F.lit(0.0)).alias("k"))
    )
    p = F.col("k") / F.col("n")
    return agg.select(
        "bin", "n", (p * 100.0).alias("rate"), (F.sqrt(p * (1 - p) / F.col("n")) * 196.0).alias("ci")
    )


def prevalence_by_bin(df: DataFrame, bin_expr: Column, flags: Sequence[str]) -> DataFrame:
    return (
        df.select(bin_expr.alias("bin"), *flags)
        .where(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), *[(F.avg(c) * 100.0).alias(c) for c in flags])
    )


def trajectory_mean(
    df: DataFrame, group: Sequence[str], hour: str, channels: Sequence[str], max_hour: int
) -> DataFrame:
    """Mean and 1.96·SEM per (group, hour, channel) up to an hour cap."""
    wide = df.where(F.col(hour) <= max_hour).groupBy(*group, hour).agg(
        *[F.count(c).alias(f"{c}__n") for c in channels],
        *[F.avg(c).alias(f"{c}__mean") for c in channels],
        *[F.stddev_samp(c).alias(f"{c}__sd") for c in channels],
    )
    return wide.select(
        *group,
        hour,
        _entries(
            [
                F.struct(
                    F.lit(c).alias("channel"),
                    F.col(f"{c}__n").alias("n"),
                    F.col(f"{c}__mean").alias("mean"),
                    F.try_divide(F.lit(1.96) * F.col(f"{c}__sd"), F.sqrt(F.col(f"{c}__n"))).alias("ci"),
                )
                for c in channels
            ]
        ),
    ).select(*group, hour, "e.*").where(F.col("n") > 0)


def cooccurrence(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Share of rows with both flags, for all pairs, in one aggregation."""
    both = {
        (a, b): F.sum(((F.col(a) == 1) & (F.col(b) == 1)).cast("long"))
        for i, a in enumerate(flags)
        for b in flags[i:]
    }
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[e.alias(f"{a}|{b}") for (a, b), e in both.items()])
    rows = []
    for a in flags:
        for b in flags:
            k = f"{a}|{b}" if (a, b) in both else f"{b}|{a}"
            rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias("k")))
    return wide.select("n", _entries(rows)).select(
        F.col("e.a").alias("a"), F.col("e.b").alias("b"), F.try_divide(F.lit(100.0) * F.col("e.k"), F.col("n")).alias("pct")
    )


#: Groups a task holds moments of before it hands them on.
HELD_GROUPS = 256
_MOMENTS = ("n", "sa", "sb", "saa", "sbb", "sab")


def pair_moments(df: DataFrame, cols: Sequence[str], shift: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """``group..., a, b, n, sa, sb, saa, sbb, sab`` for all pairs a <= b (positions in ``cols``), over rows with both values.

    Tasks add up one matrix of masked products per group, so what is shuffled is a row per pair, group and task; Spark merges
    them. ``shift`` is taken off each column first, which keeps the sums well conditioned. NULL and NaN are missing.
    """
    kinds = dict(df.dtypes)
    names = [f"__x{i}" for i in range(len(cols))]
    narrow = df.select(*group, *[F.col(c).cast("double").alias(n) for c, n in zip(cols, names)])
    ia, ib = np.triu_indices(len(cols))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def rows() -> pd.DataFrame:
            parts = []
            for key, m in held.items():
                part = pd.DataFrame({"a": ia.astype("int32"), "b": ib.astype("int32")} | dict(zip(_MOMENTS, m)))
                for c, v in zip(group, key):
                    part[c] = pd.Series([v] * len(ia), dtype=object if v is None or isinstance(v, str) else None)
                parts.append(part)
            held.clear()
            return pd.concat(parts, ignore_index=True)

        for batch in batches:
            pieces = batch.groupby(list(group), dropna=False, sort=False) if group else [((), batch)]
            for key, piece in pieces:
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                x = piece[names].to_numpy("float64", na_value=np.nan) - shift
                there = (~np.isnan(x)).astype(float)
                x = np.where(there > 0, x, 0.0)
                s, ss = x.T @ there, (x * x).T @ there
                full = (there.T @ there, s, s.T, ss, ss.T, x.T @ x)
                found = np.stack([m[ia, ib] for m in full])
                held[key] = held[key] + found if key in held else found
            if len(held) >= HELD_GROUPS:
                yield rows()
        if held:
            yield rows()

    fields = [f"{c} {kinds[c]}" for c in group] + ["a int", "b int"] + [f"{m} double" for m in _MOMENTS]
    order = [*group, "a", "b", *_MOMENTS]
    sums = narrow.mapInPandas(lambda batches: (r[order] for r in partial(batches)), ", ".join(fields))
    return sums.groupBy(*group, "a", "b").agg(*[F.sum(m).alias(m) for m in _MOMENTS])


def correlations(df: DataFrame, cols: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Pearson matrix, pairwise-complete, from one matrix of moments per group.

    Undefined entries (constant columns) are 0, also on the diagonal.
    """
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(str(i)) for i, c in enumerate(cols)]).first()
    shift = np.array([0.0 if row[i] is None or row[i] != row[i] else float(row[i]) for i in range(len(cols))])
    sums = pair_moments(df, cols, shift, group)
    n, sa, sb, saa, sbb, sab = [F.col(m) for m in _MOMENTS]
    va, vb = n * saa - sa * sa, n * sbb - sb * sb
    # a constant column leaves only rounding noise in its variance term
    flat = (va <= F.lit(1e-12) * n * saa) | (vb <= F.lit(1e-12) * n * sbb)
    r = F.coalesce(F.when(~flat, F.try_divide(n * sab - sa * sb, F.sqrt(va) * F.sqrt(vb))), F.lit(0.0))
    name = F.array(*[F.lit(c) for c in cols])
    one = lambda x, y: F.struct(F.get(name, F.col(x)).alias("a"), F.get(name, F.col(y)).alias("b"))
    both = F.when(F.col("a") == F.col("b"), F.array(one("a", "b"))).otherwise(F.array(one("a", "b"), one("b", "a")))
    return sums.select(*group, F.explode(both).alias("e"), r.alias("r")).select(*group, "e.a", "e.b", "r")


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts in equal bins over ``[lo, hi]``; the top edge belongs to the last bin."""
    v = F.col(col).cast("double")
    b = F.least(F.floor((v - F.lit(lo)) / F.lit((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return (
        df.where((v >= lo) & (v <= hi)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        .select("bin", (F.lit(lo) + F.col("bin") * F.lit((hi - lo) / bins)).alias("lo"), "n")
    )


def capped_five_numbers(df: DataFrame, col: str, group: str, cap: float | None = 0.99) -> DataFrame:
    """Min, quartiles and max per group after capping at a global quantile."""
    src = df.select(group, F.col(col).cast("double").alias("v"))
    if cap is not None:
        top = quantiles(src, ["v"], [cap]).first()["q0"]
        src = src.withColumn("v", F.when(F.col("v").isNotNull(), F.least("v", F.lit(top))))
    q = quantiles(src, ["v"], [0.0, 0.25, 0.5, 0.75, 1.0], [group])
    names = ["min", "q1", "median", "q3", "max"]
    return q.select(group, "n", *[F.col(f"q{i}").alias(f"{s}_v") for i, s in enumerate(names)])


# ---- Table 1 --------------------------------------------------------------
def median_iqr_text(med: Column, q1: Column, q3: Column) -> Column:
    return F.concat(fixed(med, 1), F.lit(" ("), fixed(q1, 1), F.lit("-"), fixed(q3, 1), F.lit(")"))


def count_pct_text(n: Column, pct: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(" ("), fixed(pct, 1), F.lit("%)"))


def table_one(
    df: DataFrame,
    continuous: Mapping[str, str],
    levels: Sequence[tuple[str, str, Column]],
    group: Sequence[str] = (),
) -> DataFrame:
    """Long Table 1: ``group..., position, variable, statistic, value``.

    ``continuous``: column -> label, shown as median (IQR).
    ``levels``: (label, key, condition) shown as n (%).
    """
    wide = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.sum(F.coalesce(cond, F.lit(False)).cast("long")).alias(f"l__{k}") for _, k, cond in levels],
    )
    def row(position, label, statistic, n):
        return F.struct(
            F.lit(position).alias("position"), F.lit(label).alias("variable"), F.lit(statistic).alias("statistic"), n.alias("n")
        )

    rows = [row(0, "N", "n", F.col("__rows"))]
    rows += [row(100 + i, label, "n (%)", F.col(f"l__{k}")) for i, (label, k, _) in enumerate(levels)]
    counted = wide.select(*group, "__rows", _entries(rows)).select(*group, "__rows", "e.*")
    pct = F.col("n") / F.col("__rows") * F.lit(100.0)
    counted = counted.select(
        *group, "position", "variable", "statistic",
        F.when(F.col("statistic") == "n", F.col("n").cast("string")).otherwise(count_pct_text(F.col("n"), pct)).alias("value"),
    )
    q = quantiles(df, list(continuous), [0.25, 0.5, 0.75], group)
    position, label = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (c, text) in enumerate(continuous.items()):
        position = F.when(F.col("variable") == c, F.lit(10 + i)).otherwise(position)
        label = F.when(F.col("variable") == c, F.lit(text)).otherwise(label)
    medians = q.select(
        *group,
        position.alias("position"),
        label.alias("variable"),
        F.lit("Median (IQR)").alias("statistic"),
        median_iqr_text(F.col("q1"), F.col("q0"), F.col("q2")).alias("value"),
    )
    return counted.unionByName(medians)


def side_by_side(table: DataFrame, group: str, groups: Sequence[str], value: str = "value") -> DataFrame:
    """Put one column per group next to each other."""
    return (
        table.groupBy("position", "variable", "statistic")
        .agg(*[F.max(F.when(F.col(group) == g, F.col(value))).alias(str(g)) for g in groups])
    )
