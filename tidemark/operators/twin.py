"""Per-entity prediction feedback and drift over finished tables (batch)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.skew import first_by, fit_blocks, null_safe_join, with_blocks

DRIFT_ALPHA = 0.3
DRIFT_THRESHOLD = 0.5


def channel_errors(predicted: Column | str, actual: Column | str) -> Column:
    """Absolute error per channel known on both sides."""
    both = F.map_zip_with(predicted, actual, lambda k, p, a: F.abs(p - a))
    return F.map_filter(both, lambda k, v: v.isNotNull())


def mean_error(errors: Column | str) -> Column:
    """Mean over an error map, NULL when it is empty."""
    values = F.map_values(errors)
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(values) > 0, total / F.size(values))


def pair_feedback(predictions: DataFrame, actuals: DataFrame, on: str = "prediction_id") -> DataFrame:
    """Join actuals to their predictions and add the error map."""
    joined = predictions.join(actuals, on)
    return joined.withColumn("error", channel_errors("predicted", "actual"))


def ema_drift(
    feedback: DataFrame,
    entity: str = "entity_id",
    time: str = "ts",
    ties: Sequence[str] = (),
    error: str = "error",
    alpha: float = DRIFT_ALPHA,
) -> DataFrame:
    """``entity, recent_drift, n_feedback``: exponential moving average of the mean error.

    The recursion is a weighted sum: a record weighs alpha·(1−alpha)^k with k
    later non-empty records, a first non-empty record weighs (1−alpha)^k. Only k
    is needed, so time blocks are numbered apart and an entity with a third of
    all records is spread over many tasks.
    """
    rows = feedback.select(
        F.col(entity), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), *ties, mean_error(error).alias("e")
    )
    rows = with_blocks(rows, ["t"], fit_blocks(rows, ["t"]))
    # records without a time come last
    rows = rows.withColumn("block", F.when(F.col("t").isNull(), float("inf")).otherwise(F.col("t__block").cast("double"))).drop("t__num", "t__block")
    per = rows.groupBy(entity, "block").agg(F.count("e").alias("filled"), F.count(F.lit(1)).alias("cnt"))
    later = Window.partitionBy(entity).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(entity).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        entity,
        "block",
        "filled",
        F.coalesce(F.sum("filled").over(later), F.lit(0)).alias("filled_later"),
        F.coalesce(F.sum("cnt").over(earlier), F.lit(0)).alias("rows_earlier"),
    )
    order = [F.col("t").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties]]
    inside = Window.partitionBy(entity, "block").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = null_safe_join(rows, per, [entity, "block"]).select(
        entity,
        "e",
        (F.col("filled_later") + F.col("filled") - F.count("e").over(upto)).alias("after"),
        ((F.row_number().over(inside) + F.col("rows_earlier")) == 1).alias("first"),
    )
    weight = F.when(F.col("first"), 1.0).otherwise(alpha) * F.pow(F.lit(1.0 - alpha), F.col("after"))
    return placed.groupBy(entity).agg(
        F.coalesce(F.sum(F.col("e") * weight), F.lit(0.0)).alias("recent_drift"),
        F.count(F.lit(1)).alias("n_feedback"),
    )


def drift_report(
    feedback: DataFrame,
    entities: DataFrame | None = None,
    entity: str = "entity_id",
    time: str = "ts",
    ties: Sequence[str] = (),
    error: str = "error",
    alpha: float = DRIFT_ALPHA,
    threshold: float = DRIFT_THRESHOLD,
) -> DataFrame:
    """Overall and per-channel mean error, moving average, recalibration flag.

    ``entities`` lists ids that must appear even without feedback (all zeros).
    Channel errors are averaged per (entity, channel) first, so the map per
    entity has one entry per channel.
    """
    cells = feedback.select(entity, F.explode(error).alias("channel", "err")).groupBy(entity, "channel").agg(
        F.sum("err").alias("s"), F.count("err").alias("n")
    )
    maes = cells.groupBy(entity).agg(
        (F.sum("s") / F.sum("n")).alias("overall_mae"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("channel", (F.col("s") / F.col("n")).alias("mae"))))
        ).alias("per_channel_mae"),
    )
    drift = ema_drift(feedback, entity, time, ties, error, alpha)
    base = drift if entities is None else entities.select(entity).distinct().join(drift, entity, "left")
    out = base.join(maes, entity, "left")
    empty = F.create_map().cast("map<string,double>")
    ema = F.coalesce(F.col("recent_drift"), F.lit(0.0))
    return out.select(
        entity,
        F.coalesce("overall_mae", F.lit(0.0)).alias("overall_mae"),
        ema.alias("recent_drift_ema"),
        F.coalesce("per_channel_mae", empty).alias("per_channel_mae"),
        ((ema > threshold) & (F.coalesce("n_feedback", F.lit(0)) > 0)).alias("needs_recalibration"),
        F.coalesce("n_feedback", F.lit(0)).cast("long").alias("n_feedback_records"),
    )


def state_snapshot(
    observations: DataFrame, predictions: DataFrame, feedback: DataFrame, drift: DataFrame,
    entity: str = "entity_id", time: str = "ts", last: int = 10, metadata: DataFrame | None = None,
) -> DataFrame:
    """Counters, current drift and the last few predictions and feedback records.

    Every observation is one assimilation; ``last_sync`` is the time of the last.
    ``metadata`` (entity, metadata map) is carried along, an empty map where unknown.
    The record lists come from a top-n per key, never from whole histories.
    """
    def counts(df, name):
        return df.groupBy(entity).agg(F.count(F.lit(1)).alias(name))

    def tail(df, name):
        order = [F.col(time).desc_nulls_last(), *[F.col(c).desc() for c in df.columns if c.endswith("_id") and c != entity]]
        kept = first_by(df, [entity], order, last, rank_col="__rn")
        payload = F.to_json(F.struct(*[c for c in df.columns if c != entity]))
        return kept.groupBy(entity).agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct((-F.col("__rn")).alias("o"), payload.alias("r")))), lambda x: x["r"]
            ).alias(name)
        )

    synced = observations.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_observations"), F.count(F.lit(1)).alias("n_assimilations"), F.max(time).alias("last_sync")
    )
    parts = [
        synced, counts(predictions, "n_predictions"), counts(feedback, "n_feedback"),
        drift.select(entity, "recent_drift"), tail(predictions, "predictions"), tail(feedback, "feedback"),
    ]
    if metadata is not None:
        parts.append(metadata.select(entity, "metadata"))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, entity, "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    none = F.array().cast("array<string>")
    if metadata is None:
        out = out.withColumn("metadata", F.lit(None).cast("map<string,string>"))
    return out.select(
        entity, "last_sync", zero("n_assimilations"), zero("n_observations"), zero("n_predictions"), zero("n_feedback"),
        F.coalesce("recent_drift", F.lit(0.0)).alias("recent_drift"),
        F.coalesce("predictions", none).alias("predictions"), F.coalesce("feedback", none).alias("feedback"),
        F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def restore_state(snapshot: DataFrame, entity: str = "entity_id") -> DataFrame:
    """What survives a restart: time of the last sync, counter, drift and
    metadata; record lists and their counts start anew."""
    return snapshot.select(entity, "last_sync", "n_assimilations", "recent_drift", "metadata")
