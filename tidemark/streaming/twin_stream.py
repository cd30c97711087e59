"""Structured Streaming forms of ingest, pairing, drift and hourly resampling.

Event time is the observation time. The default watermark is one hour: later
rows are dropped by Spark and counted in its progress metrics. Aggregates run in
update mode: the last row per key (``run.latest``) is the state so far, with
windows that are still open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.skew import fit_blocks, null_safe_join, quantiles, with_blocks
from tidemark.operators.stattests import distribution_shift
from tidemark.operators.twin import DRIFT_ALPHA, DRIFT_THRESHOLD, channel_errors, mean_error

WATERMARK = "1 hour"


def ingest_observations(stream: DataFrame) -> DataFrame:
    """Stamp the time of ingest."""
    return stream.withColumn("_ingested_at", F.current_timestamp())


def log_predictions(stream: DataFrame, entity: str = "entity_id", time: str = "ts") -> DataFrame:
    """Give every prediction an id: its own, else a hash of its content, which
    stays the same when a task is run again."""
    body = F.sha2(F.to_json(F.struct(entity, time, "predicted")), 256)
    own = F.col("prediction_id") if "prediction_id" in stream.columns else F.lit(None).cast("string")
    return stream.withColumn("prediction_id", F.coalesce(own, body))


def pair_feedback(
    predictions: DataFrame, actuals: DataFrame, within: str = "1 hour", watermark: str = WATERMARK
) -> DataFrame:
    """Stream–stream join on ``prediction_id``, which names one prediction; the
    actual follows within a bound. State and output are linear in the actuals.

    ``predictions``: prediction_id, entity_id, ts, predicted;
    ``actuals``: prediction_id, actual_ts, actual.
    """
    p = predictions.withWatermark("ts", watermark).withColumnRenamed("prediction_id", "pid")
    a = actuals.withWatermark("actual_ts", watermark)
    cond = F.expr(
        f"pid = prediction_id AND actual_ts >= ts AND actual_ts <= ts + INTERVAL {within}"
    )
    return p.join(a, cond, "inner").drop("pid").withColumn("error", channel_errors("predicted", "actual"))


def ema_blocks(
    feedback: DataFrame, entity: str = "entity_id", time: str = "ts", tie: str | None = None, error: str = "error",
    alpha: float = DRIFT_ALPHA, watermark: str = WATERMARK,
) -> DataFrame:
    """Moving average per (entity, point in time), update mode.

    A state row holds the records of one entity at one time, so that of an entity with a third of all records is as small as any
    other; the watermark closes it. A run of records folds to one pair, the number of non-empty records and their weighted sum,
    and pairs of later times compose, so records may come in any order and over any number of micro-batches. ``folded_first``
    is the sum for the records that open the entity's history. Records without a time are left out.
    """
    slim = feedback.withWatermark(time, watermark).select(
        F.col(entity).alias("entity_id"), F.col(time).alias("t"),
        (F.col(tie) if tie else F.lit(0)).alias("tie"), mean_error(error).alias("e"),
    )
    runs = slim.where(F.col("t").isNotNull()).groupBy("t", "entity_id").agg(F.array_sort(F.collect_list(F.struct("tie", "e"))).alias("run"))

    def fold(run, start):
        return F.aggregate(run, start, lambda s, x: F.when(x["e"].isNull(), s).otherwise(alpha * x["e"] + (1 - alpha) * s))

    opening = F.coalesce(F.element_at("run", 1)["e"], F.lit(0.0))
    return runs.select(
        "entity_id", F.col("t").alias("block_start"), F.size("run").cast("long").alias("n"),
        F.size(F.filter("run", lambda x: x["e"].isNotNull())).alias("filled"),
        fold(F.col("run"), F.lit(0.0)).alias("folded"),
        fold(F.slice("run", 2, F.greatest(F.size("run"), F.lit(1))), opening).alias("folded_first"),
    )


def drift_of_blocks(blocks: DataFrame, alpha: float = DRIFT_ALPHA, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """``entity_id, recent_drift, n_feedback, needs_recalibration`` from the
    pairs of :func:`ema_blocks` (the last state of each).

    Times are cut into blocks of bounded size; how many records follow a pair is
    counted within its block and over the later ones, so no entity is one task.
    """
    rows = blocks.select("entity_id", "n", "filled", "folded", "folded_first", F.unix_micros(F.col("block_start").cast("timestamp")).alias("t"))
    rows = with_blocks(rows, ["t"], fit_blocks(rows, ["t"])).withColumnRenamed("t__block", "block").drop("t__num")
    per = rows.groupBy("entity_id", "block").agg(F.sum("filled").alias("filled_here"))
    later = Window.partitionBy("entity_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("entity_id").orderBy("block")
    per = per.select("entity_id", "block", F.coalesce(F.sum("filled_here").over(later), F.lit(0)).alias("filled_later"), F.row_number().over(earlier).alias("nth"))
    after = Window.partitionBy("entity_id", "block").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy("entity_id", "block").orderBy("t"))
    placed = null_safe_join(rows, per, ["entity_id", "block"]).select(
        "entity_id", "n",
        F.when((F.col("nth") == 1) & (first == 1), F.col("folded_first")).otherwise(F.col("folded")).alias("s"),
        (F.col("filled_later") + F.coalesce(F.sum("filled").over(after), F.lit(0))).alias("after"),
    )
    drift = placed.groupBy("entity_id").agg(
        F.sum(F.col("s") * F.pow(F.lit(1.0 - alpha), F.col("after"))).alias("recent_drift"), F.sum("n").alias("n_feedback")
    )
    return drift.withColumn("needs_recalibration", F.col("recent_drift") > threshold)


def value_counts(
    events: DataFrame, time: str, keys: list[str], value: str, window: str = "1 hour", watermark: str = WATERMARK
) -> DataFrame:
    """Rows per (window, keys, value), update mode.

    One state row per distinct value, so neither a hot key nor a window that
    spans micro-batches gathers in one place. Exact medians and distribution
    tests follow from the last counts (:func:`medians_of_counts`,
    :func:`shift_of_counts`).
    """
    return (
        events.withWatermark(time, watermark)
        .groupBy(F.window(time, window), *keys, F.col(value).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), *keys, "value", "n")
    )


def medians_of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Median and rows per (window, keys); rows without a value count, but have no part in the median."""
    by = ["window_start", *keys]
    med = quantiles(counts, ["value"], [0.5], by, weight="n").select(*by, F.col("q0").alias("median_value"))
    rows = counts.groupBy(*by).agg(F.sum("n").alias("n"))
    return null_safe_join(rows, med, by, "left").select(*by, "median_value", "n")


def shift_of_counts(counts: DataFrame, channels: list[str], alpha: float = 0.05) -> DataFrame:
    """KS of observed against predicted values per window and channel.

    ``counts`` come from :func:`value_counts` with the keys ``is_real`` (1 for
    observed, 0 for predicted) and ``channel``.
    """
    columns = [F.when(F.col("channel") == c, F.col("value")).alias(c) for c in channels]
    wide = counts.select("window_start", "is_real", "n", *columns)
    real, pred = wide.where("is_real = 1"), wide.where("is_real = 0")
    return distribution_shift(real, pred, channels, ["window_start"], alpha, weight="n")


def windowed_channel_sums(
    feedback: DataFrame, time: str = "ts", window: str = "1 hour", watermark: str = WATERMARK
) -> DataFrame:
    """Mean error per (window, channel): the streaming half of the drift report."""
    return (
        feedback.withWatermark(time, watermark)
        .select(time, F.explode("error").alias("channel", "err"))
        .groupBy(F.window(time, window), "channel")
        .agg(F.avg("err").alias("mae"), F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), "channel", "mae", "n")
    )
