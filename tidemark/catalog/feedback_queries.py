"""Prediction feedback and drift, batch and streaming.

Views stand for predictions, each with its own id, and a click for an actual that
names one prediction; every purchase is one finished feedback record.
"""

import uuid

from pyspark.sql import functions as F

from tidemark.catalog.registry import KOLMOGOROV_SQL, query, r, rounded, table
from tidemark.operators import twin
from tidemark.session import checkpoint_folder, cut_lineage
from tidemark.streaming import run, twin_stream

# the click names the event that many places before it
_NAMED = "CAST(event_id - 1 - CAST(get_json_object(props, '$.k') AS BIGINT) % 10 AS STRING)"
_NAMED_SQL = "event_id - 1 - CAST(json_extract_string(props, '$.k') AS BIGINT) % 10"


def predictions(ev):
    return ev.where("event_type = 'view'").select(
        F.col("event_id").cast("string").alias("prediction_id"), F.col("user_id").alias("entity_id"), F.col("event_id").alias("view_id"), "ts",
        F.create_map(F.lit("value"), F.col("value"), F.lit("only_predicted"), F.lit(1.0)).alias("predicted"),
    )


def actuals(ev):
    return ev.where("event_type = 'click'").select(
        F.expr(_NAMED).alias("prediction_id"), F.col("event_id").alias("click_id"), F.col("ts").alias("actual_ts"),
        F.create_map(F.lit("value"), F.col("value")).alias("actual"),
    )


def feedback(ev):
    k = F.get_json_object("props", "$.k").cast("double")
    shared = F.create_map(F.lit("value"), F.col("value"), F.lit("half"), F.col("value") / 2)
    return ev.where("event_type = 'purchase'").select(
        F.col("user_id").alias("entity_id"), "ts", F.col("event_id").alias("feedback_id"),
        twin.channel_errors(
            F.create_map(F.lit("value"), k, F.lit("half"), k),
            F.when(k >= 10, shared).otherwise(F.create_map(F.lit("unseen"), F.lit(0.0))),
        ).alias("error"),
    )


_FEEDBACK = """fb AS (SELECT user_id AS entity_id, ts, event_id AS feedback_id, CASE WHEN k >= 10 THEN abs(k - value) END AS ev, CASE WHEN k >= 10 THEN abs(k - value / 2) END AS eh
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) WHERE event_type = 'purchase'),
lists AS (SELECT entity_id, list((ev + eh) / 2 ORDER BY ts, feedback_id) AS e, COUNT(*) AS n FROM fb GROUP BY entity_id),
ema AS (SELECT entity_id, n AS n_feedback, list_reduce(e[2:], lambda acc, x: CASE WHEN x IS NULL THEN acc ELSE 0.3 * x + 0.7 * acc END, COALESCE(e[1], 0.0)) AS recent_drift FROM lists)"""


@query(
    "feedback_join",
    f"""SELECT v.user_id AS entity_id, v.event_id AS view_id, c.event_id AS click_id, {r("abs(v.value - c.value)")} AS error FROM events v
    JOIN (SELECT *, {_NAMED_SQL} AS named FROM events WHERE event_type = 'click') c ON v.event_id = c.named WHERE v.event_type = 'view'""",
)
def feedback_join(spark, folder):
    ev = table(spark, folder, "events")
    j = twin.pair_feedback(predictions(ev), actuals(ev))
    return rounded(j.select("entity_id", "view_id", "click_id", F.col("error")["value"].alias("error")))


@query("feedback_ema", f"WITH {_FEEDBACK} SELECT entity_id, {r('recent_drift')} AS recent_drift, n_feedback FROM ema")
def feedback_ema(spark, folder):
    return rounded(twin.ema_drift(feedback(table(spark, folder, "events")), ties=["feedback_id"]))


@query(
    "drift_report",
    f"""WITH {_FEEDBACK}, m AS (SELECT entity_id, (COALESCE(SUM(ev), 0) + COALESCE(SUM(eh), 0)) / (COUNT(ev) + COUNT(eh)) AS overall, AVG(ev) AS mv, AVG(eh) AS mh FROM fb GROUP BY entity_id)
    SELECT c.c_custkey AS entity_id, {r("COALESCE(overall, 0)")} AS overall_mae, {r("COALESCE(recent_drift, 0)")} AS recent_drift_ema, {r("mv")} AS mae_value, {r("mh")} AS mae_half,
      COALESCE(recent_drift > 40, FALSE) AS needs_recalibration, COALESCE(n_feedback, 0) AS n_feedback_records
    FROM customer c LEFT JOIN ema ON c.c_custkey = ema.entity_id LEFT JOIN m ON c.c_custkey = m.entity_id""",
)
def drift_report(spark, folder):
    everyone = table(spark, folder, "customer").select(F.col("c_custkey").alias("entity_id"))
    rep = twin.drift_report(feedback(table(spark, folder, "events")), everyone, ties=["feedback_id"], threshold=40.0)
    maes = [F.col("per_channel_mae")[c].alias(f"mae_{c}") for c in ("value", "half")]
    return rounded(rep.select("entity_id", "overall_mae", "recent_drift_ema", *maes, "needs_recalibration", "n_feedback_records"))


@query(
    "state_snapshot",
    f"""WITH {_FEEDBACK}, o AS (SELECT user_id, COUNT(*) AS n, COUNT(*) FILTER (event_type = 'view') AS v FROM events GROUP BY user_id)
    SELECT o.user_id AS entity_id, o.n AS n_observations, o.v AS n_predictions, COALESCE(n_feedback, 0) AS n_feedback, {r("COALESCE(recent_drift, 0)")} AS recent_drift,
      CAST(LEAST(10, o.v) AS INT) AS kept_predictions, CAST(LEAST(10, COALESCE(n_feedback, 0)) AS INT) AS kept_feedback,
      (SELECT MAX(event_id) FROM events e WHERE e.user_id = o.user_id AND event_type = 'purchase' AND ts = (SELECT MAX(ts) FROM events z WHERE z.user_id = o.user_id AND z.event_type = 'purchase')) AS last_feedback
    FROM o LEFT JOIN ema ON o.user_id = ema.entity_id""",
)
def state_snapshot(spark, folder):
    ev = table(spark, folder, "events")
    fb = feedback(ev)
    obs = ev.select(F.col("user_id").alias("entity_id"), "ts")
    snap = twin.state_snapshot(obs, predictions(ev), fb, twin.ema_drift(fb, ties=["feedback_id"]))
    last = F.get_json_object(F.element_at("feedback", -1), "$.feedback_id").cast("long")
    return rounded(snap.select(
        "entity_id", "n_observations", "n_predictions", "n_feedback", "recent_drift", F.size("predictions").alias("kept_predictions"),
        F.size("feedback").alias("kept_feedback"), F.when(F.size("feedback") > 0, last).alias("last_feedback")))


@query(
    "state_restore",
    f"""WITH {_FEEDBACK}, o AS (SELECT user_id, COUNT(*) AS n, MAX(ts) AS last_sync FROM events GROUP BY user_id)
    SELECT o.user_id AS entity_id, epoch_us(o.last_sync) AS last_sync, o.n AS n_assimilations, {r("COALESCE(recent_drift, 0)")} AS recent_drift, c_mktsegment AS segment
    FROM o LEFT JOIN ema ON o.user_id = ema.entity_id LEFT JOIN customer ON o.user_id = c_custkey""",
)
def state_restore(spark, folder):
    """State written as a stage, read back and restored."""
    ev = table(spark, folder, "events")
    fb = feedback(ev)
    about = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("entity_id"), F.create_map(F.lit("segment"), "c_mktsegment").alias("metadata")
    )
    seen = ev.select(F.col("user_id").alias("entity_id"), "ts")
    known = about.join(seen, "entity_id", "left_semi")
    snap = cut_lineage(twin.state_snapshot(seen, predictions(ev), fb, twin.ema_drift(fb, ties=["feedback_id"]), metadata=known))
    back = twin.restore_state(snap)
    return rounded(back.select(
        "entity_id", F.unix_micros("last_sync").alias("last_sync"), "n_assimilations", "recent_drift", F.col("metadata")["segment"].alias("segment")))


# ---- streaming ------------------------------------------------------------
def _stream(spark, folder):
    """The events as a stream of at least four micro-batches whose files mix all
    times, and the lateness that this order of arrival needs."""
    ev = table(spark, folder, "events")
    first, last = ev.agg(F.min("ts"), F.max("ts")).first()
    late = f"{(last - first).days + 1} days" if first else "1 hour"
    base = f"{checkpoint_folder(spark)}/events-{uuid.uuid4().hex}"
    n = max(4, ev.rdd.getNumPartitions())
    ev.repartition(n, "event_id").write.parquet(base)
    return run.file_stream(spark, base, "*.parquet", files_per_trigger=max(1, n // 4)), late


@query(
    "stream_hourly_medians",
    f"""SELECT date_trunc('hour', ts) AS hour_start, user_id, event_type, {r("MEDIAN(value)")} AS median_value, COUNT(*) AS n FROM events GROUP BY ALL""",
)
def stream_hourly_medians(spark, folder):
    s, late = _stream(spark, folder)
    keys = ["user_id", "event_type"]
    counts = run.run_available(twin_stream.value_counts(s, "ts", keys, "value", watermark=late), "update")
    med = twin_stream.medians_of_counts(run.latest(counts, "window_start", *keys, "value"), keys)
    return rounded(med.withColumnRenamed("window_start", "hour_start"))


@query(
    "stream_feedback_join",
    f"""SELECT v.user_id AS entity_id, v.event_id AS view_id, c.event_id AS click_id, {r("abs(v.value - c.value)")} AS error FROM events v
    JOIN (SELECT *, {_NAMED_SQL} AS named FROM events WHERE event_type = 'click') c ON v.event_id = c.named AND c.ts >= v.ts AND c.ts <= v.ts + INTERVAL 1 HOUR
    WHERE v.event_type = 'view'""",
)
def stream_feedback_join(spark, folder):
    s, late = _stream(spark, folder)
    logged = twin_stream.log_predictions(predictions(s))
    joined = twin_stream.pair_feedback(logged, actuals(s), watermark=late)
    out = run.run_available(joined.select("entity_id", "view_id", "click_id", F.col("error")["value"].alias("error")))
    return rounded(out.drop("epoch"))


@query(
    "stream_feedback_ema",
    f"WITH {_FEEDBACK} SELECT entity_id, {r('recent_drift')} AS recent_drift, n_feedback, recent_drift > 40 AS needs_recalibration FROM ema",
)
def stream_feedback_ema(spark, folder):
    s, late = _stream(spark, folder)
    fb = twin_stream.ingest_observations(feedback(s))
    updates = run.run_available(twin_stream.ema_blocks(fb, tie="feedback_id", watermark=late), "update")
    return rounded(twin_stream.drift_of_blocks(run.latest(updates, "entity_id", "block_start"), threshold=40.0))


@query(
    "stream_channel_errors",
    f"""WITH {_FEEDBACK}, x AS (SELECT ts, 'value' AS channel, ev AS err FROM fb UNION ALL SELECT ts, 'half', eh FROM fb)
    SELECT date_trunc('day', ts) AS window_start, channel, {r("AVG(err)")} AS mae, COUNT(err) AS n FROM x WHERE err IS NOT NULL GROUP BY ALL""",
)
def stream_channel_errors(spark, folder):
    s, late = _stream(spark, folder)
    updates = run.run_available(twin_stream.windowed_channel_sums(feedback(s), window="1 day", watermark=late), "update")
    return rounded(run.latest(updates, "window_start", "channel"))


_SHIFT_SQL = """steps AS (SELECT w, SUM(r) OVER o AS c1, SUM(s) OVER o AS c2, SUM(r) OVER (PARTITION BY w) AS n1, SUM(s) OVER (PARTITION BY w) AS n2 FROM (
    SELECT w, v, CAST(SUM(r) AS DOUBLE) AS r, CAST(SUM(1 - r) AS DOUBLE) AS s FROM sides WHERE v IS NOT NULL GROUP BY w, v) WINDOW o AS (PARTITION BY w ORDER BY v)),
  gaps AS (SELECT w, CAST(MAX(n1) AS BIGINT) AS n_real, CAST(MAX(n2) AS BIGINT) AS n_synth, MAX(abs(c1 / n1 - c2 / n2)) AS d FROM steps GROUP BY w),
  told AS (SELECT *, CASE WHEN n_real >= 2 AND n_synth >= 2 THEN d END AS ks FROM gaps),
  scaled AS (SELECT *, ks * sqrt(CAST(n_real AS DOUBLE) * n_synth / (n_real + n_synth)) AS x FROM told),
  tested AS (SELECT *, """ + KOLMOGOROV_SQL + """ AS p FROM scaled)"""


def shift_sql(sides: str, name: str) -> str:
    """The SQL twin of a window shift over ``sides`` (w, v, r = 1 for the first side)."""
    return f"""WITH sides AS ({sides}), {_SHIFT_SQL} SELECT w AS {name}, 'value' AS variable, n_real, n_synth, {r("ks")} AS ks_stat, {r("p")} AS pvalue,
    CASE WHEN ks IS NULL THEN 'insufficient data' END AS note, COALESCE(p < 0.05, FALSE) AS any_significant FROM tested"""


@query(
    "stream_window_shift",
    shift_sql("SELECT date_trunc('day', ts) AS w, value AS v, CAST(event_type = 'view' AS INT) AS r FROM events WHERE event_type IN ('view', 'click')", "window_start"),
)
def stream_window_shift(spark, folder):
    """Views against clicks per day."""
    s, late = _stream(spark, folder)
    tagged = s.where("event_type IN ('view', 'click')").select(
        "ts", "value", (F.col("event_type") == "view").cast("int").alias("is_real"), F.lit("value").alias("channel")
    )
    keys = ["is_real", "channel"]
    counts = run.run_available(twin_stream.value_counts(tagged, "ts", keys, "value", "1 day", late), "update")
    return rounded(twin_stream.shift_of_counts(run.latest(counts, "window_start", *keys, "value"), ["value"]))
