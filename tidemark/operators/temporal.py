"""Shape of series: sequence distance and autocorrelation comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.neighbors import nearest_distances
from tidemark.operators.prep import fit_minmax, random_sample
from tidemark.operators.skew import quantiles
from tidemark.session import cut_lineage


def flat_sequences(seqs: DataFrame, key: str, channels: Sequence[str]) -> DataFrame:
    """Channel arrays of one length as one vector per key."""
    return seqs.select(key, F.concat(*[F.col(c) for c in channels]).alias("vec"))


def sequence_distance(
    real: DataFrame, synth: DataFrame, key: str, channels: Sequence[str], n_samples: int | None = None,
    seed: int = 42, **kw,
) -> DataFrame:
    """Euclidean distance of every real sequence to its nearest synthetic one:
    mean, median, population std. All sequences by default; ``n_samples`` draws
    a reproducible subset of either side."""
    if n_samples is not None:
        real, synth = (random_sample(d, [key], n_samples, seed) for d in (real, synth))
    near = cut_lineage(
        nearest_distances(
            flat_sequences(real, key, channels), flat_sequences(synth, key, channels), key, **kw
        ).select(F.col("distances")[0].alias("distance"))
    )
    median = quantiles(near, ["distance"], [0.5]).first()["q0"]
    return near.agg(
        F.avg("distance").alias("mean_distance"),
        F.lit(median).alias("median_distance"),
        F.stddev_pop("distance").alias("std_distance"),
    )


def scale_sequences(seqs: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Global per-channel min-max to [−1, 1]; a constant channel has range 1."""
    ends = seqs.select(
        *[F.array_min(c).alias(f"{c}__lo") for c in channels], *[F.array_max(c).alias(f"{c}__hi") for c in channels]
    )
    fit = fit_minmax(ends, ends.columns)

    def scaled(c: str) -> Column:
        lo, hi = fit[f"{c}__lo"]["min"], fit[f"{c}__hi"]["max"]
        width = (hi - lo) or 1.0
        return F.transform(c, lambda x: F.lit(2.0) * (x - F.lit(lo)) / F.lit(width) - 1.0)

    return seqs.withColumns({c: scaled(c) for c in channels})


def autocorrelations(seqs: DataFrame, channels: Sequence[str], max_lag: int = 12) -> DataFrame:
    """Mean autocorrelation per (channel, lag) over all sequences.

    NULL steps are removed; series shorter than ``max_lag + 1`` or without
    variance are left out. Arrays have the fixed sequence length, so each row is
    small and everything stays in one stage before a tiny aggregation.
    """
    long = seqs.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("channel"), F.filter(F.col(c), lambda x: x.isNotNull()).alias("x")) for c in channels])
        ).alias("e")
    ).select("e.*")
    long = long.where(F.size("x") >= max_lag + 1)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    long = long.withColumn("m", total(F.col("x")) / F.size("x"))
    long = long.withColumn("x", F.transform("x", lambda v: v - F.col("m")))
    long = long.withColumn("ss", F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    scale = F.aggregate("x", F.lit(0.0), lambda s, v: F.greatest(s, F.abs(v)))
    long = long.where((F.col("ss") > 0) & (scale > F.lit(1e-12) * F.greatest(F.abs("m"), F.lit(1e-300))))
    lagged = F.transform(
        F.sequence(F.lit(0), F.lit(max_lag)),
        lambda k: F.aggregate(
            F.zip_with(
                F.slice("x", F.lit(1), F.size("x") - k), F.slice("x", k + 1, F.size("x") - k), lambda a, b: a * b
            ),
            F.lit(0.0),
            lambda s, v: s + v,
        )
        / F.col("ss"),
    )
    return (
        long.select("channel", F.posexplode(lagged).alias("lag", "r"))
        .groupBy("channel", "lag")
        .agg(F.avg("r").alias("acf"), F.count(F.lit(1)).alias("n"))
    )


def compare_autocorrelations(real: DataFrame, synth: DataFrame, channels: Sequence[str], max_lag: int = 12) -> DataFrame:
    """Mean and largest absolute gap of the mean autocorrelations per channel,
    with both curves. Channels without a usable series on a side are absent."""
    r = autocorrelations(real, channels, max_lag).select("channel", "lag", F.col("acf").alias("real_acf"))
    s = autocorrelations(synth, channels, max_lag).select("channel", "lag", F.col("acf").alias("synth_acf"))
    gap = F.abs(F.col("real_acf") - F.col("synth_acf"))
    curve = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("lag", c))), lambda p: p[c])
    return r.join(s, ["channel", "lag"]).groupBy("channel").agg(
        F.avg(gap).alias("mean_diff"),
        F.max(gap).alias("max_diff"),
        curve("real_acf").alias("real_acf"),
        curve("synth_acf").alias("synth_acf"),
    )
