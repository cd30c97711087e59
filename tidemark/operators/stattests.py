"""Statistical tests and interval estimates as joins and aggregations.

Ranks and empirical distribution functions come from value counts and block
offsets (:mod:`tidemark.operators.skew`); only finished statistics meet the
distribution tails.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import distributions as dist
from tidemark.functions.exprs import numeric_columns
from tidemark.functions.formatting import fixed
from tidemark.operators.prep import category_counts
from tidemark.operators.skew import fit_blocks, running_sums, value_sums


def both_sides(real: DataFrame, synth: DataFrame, cols: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Stack two tables with ``is_real`` 1 / 0, shared columns only."""
    take = [*group, *cols]
    return real.select(*take, F.lit(1).alias("is_real")).unionByName(
        synth.select(*take, F.lit(0).alias("is_real"))
    )


def shared_numeric(real: DataFrame, synth: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [c for c in numeric_columns(real, exclude) if c in synth.columns]


def ks_tests(
    real: DataFrame, synth: DataFrame, cols: Sequence[str], group: Sequence[str] = (), min_size: int = 1,
    p_values: bool = True, method: str = "limit", weight: str | None = None,
) -> DataFrame:
    """Two-sample Kolmogorov–Smirnov per column: ``variable, n_real, n_synth,
    ks_stat, pvalue``. Samples below ``min_size`` give NULL. ``method`` names the
    law of the p-value, ``limit`` or ``exact``, whatever the sample sizes. A row
    counts ``weight`` times (once by default)."""
    stacked = both_sides(real, synth, [*cols, *([weight] if weight else [])], group)
    times = F.col(weight) if weight else F.lit(1)
    edges = fit_blocks(stacked, cols)
    counts = value_sums(stacked, group, cols, edges, {"n1": F.col("is_real") * times, "n2": (1 - F.col("is_real")) * times})
    part = [*group, "variable"]
    runs = running_sums(counts, part, ["n1", "n2"], edges is not None)
    gap = F.abs(
        F.try_divide(F.col("n1_before") + F.col("n1"), F.col("n1_total"))
        - F.try_divide(F.col("n2_before") + F.col("n2"), F.col("n2_total"))
    )
    res = runs.groupBy(*part).agg(
        F.max("n1_total").alias("n_real"), F.max("n2_total").alias("n_synth"), F.max(gap).alias("ks_stat")
    )
    enough = (F.col("n_real") >= min_size) & (F.col("n_synth") >= min_size)
    res = res.withColumn("ks_stat", F.when(enough, F.col("ks_stat")))
    if not p_values:
        return res
    return res.withColumn("pvalue", dist.ks_p_cols[method](F.col("ks_stat"), F.col("n_real"), F.col("n_synth")))


def distribution_shift(
    real: DataFrame, predicted: DataFrame, channels: Sequence[str], group: Sequence[str] = (), alpha: float = 0.05,
    weight: str | None = None,
) -> DataFrame:
    """KS per channel on two windows; short channels are noted, not tested, and
    every row carries whether any channel of its group is significant."""
    tests = ks_tests(real, predicted, channels, group, min_size=2, weight=weight)
    anyw = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    return tests.withColumn(
        "note", F.when(F.col("ks_stat").isNull(), F.lit("insufficient data"))
    ).withColumn("any_significant", F.max(F.coalesce(F.col("pvalue") < alpha, F.lit(False))).over(anyw))


def rank_sums(df: DataFrame, cols: Sequence[str], group: str, groups: Sequence) -> DataFrame:
    """Per variable: n and rank sum of every group (average ranks over ties),
    total n and the tie term Σ(t³ − t)."""
    named = {f"g{i}": (F.col(group) == F.lit(g)) for i, g in enumerate(groups)}
    rows = df.where(F.col(group).isin(list(groups)))
    edges = fit_blocks(rows, cols)
    counts = value_sums(rows, [], cols, edges, {"cnt": F.lit(1), **{k: c.cast("int") for k, c in named.items()}})
    runs = running_sums(counts, ["variable"], ["cnt"], edges is not None)
    rank = F.col("cnt_before") + (F.col("cnt") + 1) / 2.0
    t = F.col("cnt").cast("double")
    return runs.groupBy("variable").agg(
        F.max("cnt_total").alias("n"),
        F.sum(t * t * t - t).alias("ties"),
        *[F.sum(k).alias(f"n_{k}") for k in named],
        *[F.sum(F.col(k) * rank).alias(f"r_{k}") for k in named],
    )


def kruskal_wallis(
    df: DataFrame, cols: Sequence[str], group: str, groups: Sequence, p_values: bool = True
) -> DataFrame:
    """Tie-corrected H per variable over the listed groups (empty ones are skipped)."""
    rs = rank_sums(df, cols, group, groups)
    n = F.col("n").cast("double")
    total, k = F.lit(0.0), F.lit(0)
    for i in range(len(groups)):
        total = total + F.coalesce(F.try_divide(F.col(f"r_g{i}") * F.col(f"r_g{i}"), F.col(f"n_g{i}")), F.lit(0.0))
        k = k + (F.col(f"n_g{i}") > 0).cast("int")
    h = F.lit(12.0) / (n * (n + 1)) * total - F.lit(3.0) * (n + 1)
    h = F.try_divide(h, F.lit(1.0) - F.try_divide(F.col("ties"), n * n * n - n))
    res = rs.select("variable", "n", h.alias("statistic"), (k - 1).alias("df"))
    return res.withColumn("pvalue", dist.chi2_sf_col(F.col("statistic"), F.col("df"))) if p_values else res


def mann_whitney(
    df: DataFrame, cols: Sequence[str], group: str, first, second, p_values: bool = True
) -> DataFrame:
    """U of the first group and the two-sided tie- and continuity-corrected normal p."""
    rs = rank_sums(df, cols, group, [first, second])
    n1, n2 = F.col("n_g0").cast("double"), F.col("n_g1").cast("double")
    n = n1 + n2
    u1 = F.col("r_g0") - n1 * (n1 + 1) / 2.0
    top = F.greatest(u1, n1 * n2 - u1)
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(top - n1 * n2 / 2.0 - 0.5, sd)
    res = rs.select(
        "variable", F.col("n_g0").alias("n1"), F.col("n_g1").alias("n2"), u1.alias("u"), z.alias("z")
    )
    return (
        res.withColumn("pvalue", F.least(F.lit(1.0), dist.normal_two_sided_col(F.greatest(F.col("z"), F.lit(0.0)))))
        if p_values
        else res
    )


def chi_square(df: DataFrame, cols: Sequence[str], group: str, p_values: bool = True) -> DataFrame:
    """Independence of every categorical column and the group, with the
    continuity correction for 2×2 tables. Empty cells need no grid: χ² is
    N·(Σ O²/(R·C) − 1)."""
    cells = category_counts(df, cols, [group]).where(
        F.col("category").isNotNull() & F.col(group).isNotNull()
    )
    # a category has one cell per group, so its window is short; a group may have
    # a cell of every category, so its sums are aggregated and joined back
    rows = Window.partitionBy("variable", "category")
    cells = cells.withColumn("r", F.sum("n").over(rows))
    cells = cells.withColumn("fr", F.row_number().over(rows.orderBy(F.col(group))) == 1)
    sums = cells.groupBy("variable", group).agg(F.sum("n").alias("c"))
    widths = sums.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n_cols"), F.sum(F.lit(1.0) / F.col("c")).alias("inv_c")
    )
    o = F.col("n").cast("double")
    agg = cells.join(sums, ["variable", group]).groupBy("variable").agg(
        F.sum("n").alias("n"),
        F.sum(o * o / (F.col("r").cast("double") * F.col("c"))).alias("s"),
        F.sum(F.col("fr").cast("int")).alias("n_rows"),
        F.sum(F.when(F.col("fr"), F.lit(1.0) / F.col("r"))).alias("inv_r"),
    ).join(widths, "variable")
    n = F.col("n").cast("double")
    plain = F.greatest(n * (F.col("s") - 1), F.lit(0.0))
    inverse_expected = n * F.col("inv_r") * F.col("inv_c")
    gap = F.sqrt(F.try_divide(plain, inverse_expected))
    corrected = F.pow(gap - F.least(F.lit(0.5), gap), 2) * inverse_expected
    df_ = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    res = agg.select(
        "variable",
        "n",
        F.when(df_ == 0, 0.0).when(df_ == 1, corrected).otherwise(plain).alias("statistic"),
        df_.cast("int").alias("df"),
    )
    if not p_values:
        return res
    return res.withColumn(
        "pvalue",
        F.when(F.col("df") == 0, 1.0).otherwise(dist.chi2_sf_col(F.col("statistic"), F.greatest("df", F.lit(1)))),
    )


def welch(df: DataFrame, cols: Sequence[str], group: str, first, second, p_values: bool = True) -> DataFrame:
    """Welch t and degrees of freedom per column, first group minus second."""
    def pick(fn, c, g):
        return fn(F.when(F.col(group) == F.lit(g), F.col(c).cast("double")))

    wide = df.agg(
        *[
            pick(fn, c, g).alias(f"{c}__{s}{i}")
            for c in cols
            for i, g in enumerate((first, second))
            for s, fn in (("n", F.count), ("m", F.avg), ("v", F.var_samp))
        ]
    )
    rows = []
    for c in cols:
        n1, m1, v1, n2, m2, v2 = [F.col(f"{c}__{s}{i}") for i in (0, 1) for s in ("n", "m", "v")]
        a, b = v1 / n1, v2 / n2
        rows.append(
            F.struct(
                F.lit(c).alias("variable"),
                F.try_divide(m1 - m2, F.sqrt(a + b)).alias("statistic"),
                F.try_divide((a + b) * (a + b), a * a / (n1 - 1) + b * b / (n2 - 1)).alias("df"),
            )
        )
    res = wide.select(F.explode(F.array(*rows)).alias("e")).select("e.*")
    return res.withColumn("pvalue", dist.t_two_sided_col(F.col("statistic"), F.col("df"))) if p_values else res


def p_text(p: Column) -> Column:
    """Printed p-value."""
    return F.when(p < 0.001, F.lit("<0.001")).otherwise(fixed(p, 3))


def rubin_pool(
    metrics: DataFrame,
    by: Sequence[str] = ("model", "metric"),
    value: str = "value",
    variance: str | None = None,
    intervals: bool = True,
) -> DataFrame:
    """Pool M estimates per group: mean, between/within/total variance, 95 % interval.

    Non-finite estimates are skipped; a group without any keeps a row of NULLs.
    """
    v = F.col(value).cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    good = F.when(ok, v)
    within = F.avg(F.when(ok, F.col(variance).cast("double"))) if variance else F.lit(0.0)
    agg = metrics.groupBy(*by).agg(
        F.count(good).alias("m"),
        F.avg(good).alias("pooled_estimate"),
        F.coalesce(F.var_samp(good), F.lit(0.0)).alias("between_variance"),
        F.coalesce(within, F.lit(0.0)).alias("within_variance"),
    )
    m = F.col("m").cast("double")
    b = F.col("between_variance")
    t = F.try_divide(F.col("within_variance"), m) + (F.lit(1.0) + F.try_divide(F.lit(1.0), m)) * b
    res = agg.withColumn("total_variance", t)
    if not intervals:
        return res
    r = F.try_divide((F.lit(1.0) + F.try_divide(F.lit(1.0), m)) * b, F.col("total_variance"))
    nu = F.when(r > 0, (m - 1) * F.pow(F.lit(1.0) + F.try_divide(F.lit(1.0), r), 2))
    crit = F.coalesce(dist.t_quantile_col(F.lit(0.975), F.greatest(nu, F.lit(1.0))), F.lit(1.96))
    margin = F.when(F.col("total_variance") > 0, F.col("crit") * F.sqrt("total_variance")).otherwise(0.0)
    res = res.withColumn("nu", nu)
    res = res.withColumn("crit", F.when(F.col("nu").isNull(), F.lit(1.96)).otherwise(crit))
    return res.select(
        *by, "m", "pooled_estimate", "between_variance", "within_variance", "total_variance",
        (F.col("pooled_estimate") - margin).alias("ci_lower"),
        (F.col("pooled_estimate") + margin).alias("ci_upper"),
    )


def pooled_text(est: Column, lo: Column, hi: Column) -> Column:
    """``est [lo, hi]`` to four places, empty when there is no estimate."""
    return (
        F.when(est.isNull(), F.lit(""))
        .when(lo.isNull() | hi.isNull(), fixed(est, 4))
        .otherwise(F.concat(fixed(est, 4), F.lit(" ["), fixed(lo, 4), F.lit(", "), fixed(hi, 4), F.lit("]")))
    )


def gaussian_interval(mean: Column, std: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    z = F.lit(dist.normal_quantile(1 - alpha / 2))
    return mean - z * std, mean + z * std
