"""Event log to hourly wide series: resample, pivot, fill, clip, sequences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions.exprs import clip, hour_since
from tidemark.operators.skew import HOT_ROWS, first_by, hot_groups, null_safe_join, quantiles, split_hot
from tidemark.session import cut_lineage


def with_hour(
    events: DataFrame, starts: DataFrame, key: str, time: str, start: str, max_hours: int
) -> DataFrame:
    """Join the event log to one start per key and keep hours ``0..max_hours``."""
    joined = events.join(starts, key).withColumn("hour", hour_since(F.col(time), F.col(start)))
    return joined.where((F.col("hour") >= 0) & (F.col("hour") <= F.lit(max_hours)))


def hourly_medians(
    events: DataFrame,
    keys: Sequence[str],
    item: str,
    items: Mapping[int | str, str],
    value: Column | str,
    hot_rows: int = HOT_ROWS,
    hot_rate: float = 0.01,
) -> DataFrame:
    """Median per (keys, item), one column per item.

    The narrow rows are written once, so that what they come from, often a join,
    is not run again to look for hot groups. Ordinary groups: one shuffle of them
    on ``keys`` serves both the median per item and the pivot. Groups too large
    for one task go through value blocks.
    """
    v = F.col(value) if isinstance(value, str) else value
    rows = events.select(*keys, F.col(item).alias("__item"), v.cast("double").alias("__val")).where(
        F.col("__val").isNotNull() & F.col("__item").isin(list(items))
    )
    rows = cut_lineage(rows)

    def plain(df: DataFrame) -> DataFrame:
        med = df.repartition(*keys).groupBy(*keys, "__item").agg(F.median("__val").alias("__m"))
        return med.groupBy(*keys).agg(
            *[F.max(F.when(F.col("__item") == i, F.col("__m"))).alias(n) for i, n in items.items()]
        )

    hot = hot_groups(rows, keys, hot_rows, hot_rate)
    if hot is None:
        return plain(rows)
    cold_rows, hot_rows_df = split_hot(rows, keys, hot)
    med = quantiles(hot_rows_df, ["__val"], [0.5], [*keys, "__item"])
    wide = med.groupBy(*keys).agg(
        *[F.max(F.when(F.col("__item") == i, F.col("q0"))).alias(n) for i, n in items.items()]
    )
    return plain(cold_rows).unionByName(wide)


def hourly_column_medians(
    df: DataFrame,
    keys: Sequence[str],
    cols: Mapping[str, str],
    hot_rows: int = HOT_ROWS,
    hot_rate: float = 0.01,
) -> DataFrame:
    """Median of several value columns per key (the wide-log form); rows are written once, as in ``hourly_medians``."""
    df = cut_lineage(df.select(*keys, *cols))

    def plain(d: DataFrame) -> DataFrame:
        return d.groupBy(*keys).agg(*[F.median(F.col(c)).alias(n) for c, n in cols.items()])

    hot = hot_groups(df, keys, hot_rows, hot_rate)
    if hot is None:
        return plain(df)
    cold_rows, hot_rows_df = split_hot(df, keys, hot)
    med = quantiles(hot_rows_df, list(cols), [0.5], list(keys))
    wide = med.groupBy(*keys).agg(
        *[F.max(F.when(F.col("variable") == c, F.col("q0"))).alias(n) for c, n in cols.items()]
    )
    all_hot = null_safe_join(hot_rows_df.select(*keys).distinct(), wide, list(keys), "left")
    return plain(cold_rows).unionByName(all_hot)


def forward_fill(
    df: DataFrame, key: Sequence[str], order: str, cols: Sequence[str], block: int = 4096
) -> DataFrame:
    """Last value seen so far, per key in ``order``; leading NULLs stay.

    The order column is cut into blocks of ``block`` units. Each block is filled
    on its own and starts from the last value of the blocks before it, so a key
    with a very long series is spread over many tasks.
    """
    blocked = df.withColumn("__block", F.floor(F.col(order) / F.lit(block)))
    lasts = blocked.groupBy(*key, "__block").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__l_{c}") for c in cols]
    )
    before = Window.partitionBy(*key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = lasts.select(
        *key, "__block", *[F.last(f"__l_{c}", ignorenulls=True).over(before).alias(f"__c_{c}") for c in cols]
    )
    inside = (
        Window.partitionBy(*key, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = null_safe_join(blocked, carry, [*key, "__block"])
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"__c_{c}")) for c in cols}
    return joined.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def forward_fill_bounded(
    df: DataFrame, key: Sequence[str], order: str, cols: Sequence[str]
) -> DataFrame:
    """Forward fill for series known to be short: one row per (key, hour) and an
    hour cap upstream bound every key, so a plain window per key is safe."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.last(c, ignorenulls=True).over(w) for c in cols}
    return df.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def clip_channels(df: DataFrame, ranges: Mapping[str, tuple] = vocab.CLIP_RANGES) -> DataFrame:
    """Clip the channels that are present; NULL stays NULL."""
    present = {c: r for c, r in ranges.items() if c in df.columns}
    return df.withColumns({c: clip(c, lo, hi) for c, (lo, hi) in present.items()})


def first_steps(df: DataFrame, key: Sequence[str], order: str, n: int) -> DataFrame:
    """First ``n`` rows per key, numbered in ``step`` (1-based)."""
    return first_by(df, key, [F.col(order).asc_nulls_last()], n, rank_col="step")


def entities_with_steps(df: DataFrame, key: str, at_least: int) -> DataFrame:
    """Keys with at least so many rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_steps")).where(F.col("n_steps") >= at_least)


def padded_sequences(
    df: DataFrame, key: Sequence[str], order: str, channels: Sequence[str], seq_len: int, pad: float = 0.0
) -> DataFrame:
    """One row per key: an array of ``seq_len`` values per channel, NULL and
    missing steps padded. Only ``seq_len`` rows per key are ever collected."""
    kept = first_steps(df, key, order, seq_len)
    rows = kept.groupBy(*key).agg(
        F.array_sort(
            F.collect_list(
                F.struct("step", *[F.coalesce(F.col(c).cast("double"), F.lit(pad)).alias(c) for c in channels])
            )
        ).alias("__s")
    )
    padding = F.array_repeat(F.lit(float(pad)), F.greatest(F.lit(seq_len) - F.size("__s"), F.lit(0)))
    return rows.select(
        *key, *[F.concat(F.col("__s").getField(c), padding).alias(c) for c in channels]
    )


def dense_grid(
    df: DataFrame, key: Sequence[str], hour: str, channels: Sequence[str], cap_hours: int = 168, fill: float = 0.0
) -> DataFrame:
    """Hour-addressed grid: every key gets hours ``0..H-1``, gaps filled, where H
    is the longest series capped at ``cap_hours``. Repeated hours keep the
    largest reading per channel."""
    seen = df.where((F.col(hour) >= 0) & (F.col(hour) < cap_hours))
    top = df.agg(F.max(hour)).first()[0]
    width = min(int(top) + 1 if top is not None else 0, cap_hours)
    if width <= 0:
        return seen.select(*key, F.col(hour).cast("int").alias(hour), *channels)
    cells = seen.groupBy(*key, F.col(hour).cast("int").alias(hour)).agg(
        *[F.max(F.col(c).cast("double")).alias(c) for c in channels]
    )
    grid = df.select(*key).distinct().select(
        *key, F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias(hour)
    )
    return grid.join(cells, [*key, hour], "left").fillna(fill, subset=list(channels))


def series_summary(df: DataFrame, key: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation of every channel per key."""
    return df.groupBy(*key).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in channels],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in channels],
    )
