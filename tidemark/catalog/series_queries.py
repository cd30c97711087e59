"""Series shaping: fill, clip, sequences, grids, summaries."""

from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.catalog.clinical import CHART_SQL, series
from tidemark.catalog.registry import query, r, rounded, rs, table
from tidemark.functions.exprs import celsius_guarded, micros, strict_sum
from tidemark.operators import timeseries as ts
from tidemark.plans.preprocessing import preprocess_series

TYPES = ["click", "error", "purchase", "signup", "view"]

# one row per (user, whole hour since the user's first) with the mean value per event type
HOURLY_SQL = f"""hourly AS (SELECT user_id, h - MIN(h) OVER (PARTITION BY user_id) AS hour, {", ".join(TYPES)} FROM (
  SELECT user_id, CAST(floor(epoch_us(ts) / 3600000000.0) AS BIGINT) AS h,
    {", ".join(f"AVG(CASE WHEN event_type = '{t}' THEN value END) AS {t}" for t in TYPES)} FROM events GROUP BY ALL))"""


def hourly(spark, folder):
    ev = table(spark, folder, "events")
    hour = F.floor(micros("ts") / F.lit(3_600_000_000)).alias("hour")
    means = ev.groupBy("user_id", hour).agg(*[F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(t) for t in TYPES])
    starts = means.groupBy("user_id").agg(F.min("hour").alias("start"))
    return means.join(starts, "user_id").select("user_id", (F.col("hour") - F.col("start")).alias("hour"), *TYPES)


@query(
    "ffill_clip",
    f"""WITH {CHART_SQL} SELECT subject_id, stay_id, hour, {", ".join(
        f"{r(f'CASE WHEN f_{c} IS NOT NULL THEN LEAST(GREATEST(f_{c}, {lo}), {hi}) END')} AS {c}" for c, (lo, hi) in vocab.CLIP_RANGES.items())}
    FROM (SELECT subject_id, stay_id, hour, {", ".join(
        f"LAST_VALUE({c} IGNORE NULLS) OVER (PARTITION BY stay_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f_{c}" for c in vocab.CHANNELS)}
    FROM series)""",
)
def ffill_clip(spark, folder):
    return rounded(preprocess_series(series(spark, folder), hour_capped=True))


@query(
    "ffill_blocks",
    f"""WITH {HOURLY_SQL} SELECT user_id, hour, {", ".join(
        r(f"LAST_VALUE({c} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)") + f" AS {c}" for c in TYPES)} FROM hourly""",
)
def ffill_blocks(spark, folder):
    return rounded(ts.forward_fill(hourly(spark, folder), ["user_id"], "hour", TYPES, block=96))


@query(
    "ffill_zero",
    f"""WITH {HOURLY_SQL} SELECT user_id, hour, {", ".join(
        r(f"COALESCE(LAST_VALUE({c} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)") + f" AS {c}" for c in TYPES)} FROM hourly""",
)
def ffill_zero(spark, folder):
    return rounded(ts.forward_fill(hourly(spark, folder), ["user_id"], "hour", TYPES).fillna(0.0, subset=TYPES))


@query(
    "first_steps",
    f"""WITH {HOURLY_SQL}, kept AS (SELECT user_id FROM hourly GROUP BY user_id HAVING COUNT(*) >= 24)
    SELECT user_id, hour, step, {r("purchase")} AS purchase FROM (SELECT h.*, CAST(ROW_NUMBER() OVER (PARTITION BY h.user_id ORDER BY hour) AS INT) AS step
    FROM hourly h JOIN kept k ON h.user_id = k.user_id) WHERE step <= 24""",
)
def first_steps(spark, folder):
    h = hourly(spark, folder)
    long_enough = ts.entities_with_steps(h, "user_id", 24).select("user_id")
    return rounded(
        ts.first_steps(h.join(long_enough, "user_id", "left_semi"), ["user_id"], "hour", 24).select("user_id", "hour", "step", "purchase")
    )


SEQ_SQL = f"""{HOURLY_SQL}, steps AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY hour) AS step FROM hourly),
seqs AS (SELECT user_id, list(COALESCE(click, 0.0) ORDER BY step) AS click0, list(COALESCE(view, 0.0) ORDER BY step) AS view0 FROM steps WHERE step <= 24 GROUP BY user_id),
padded AS (SELECT user_id, list_concat(click0, list_transform(range(24 - len(click0)), lambda x: 0.0)) AS click,
                  list_concat(view0, list_transform(range(24 - len(view0)), lambda x: 0.0)) AS view FROM seqs)"""


def sequences(spark, folder, seq_len=24):
    return ts.padded_sequences(hourly(spark, folder), ["user_id"], "hour", ["click", "view"], seq_len)


@query(
    "sequence_pad",
    f"""WITH {SEQ_SQL} SELECT user_id, CAST(pos AS INT) AS pos, {r("click[pos + 1]")} AS click, {r("view[pos + 1]")} AS view
    FROM (SELECT *, unnest(range(24)) AS pos FROM padded)""",
)
def sequence_pad(spark, folder):
    s = sequences(spark, folder).select("user_id", F.posexplode(F.arrays_zip("click", "view")).alias("pos", "z"))
    return rounded(s.select("user_id", "pos", F.col("z.click").alias("click"), F.col("z.view").alias("view")))


@query(
    "dense_grid",
    f"""WITH {HOURLY_SQL}, grid AS (SELECT user_id, hour FROM (SELECT DISTINCT user_id FROM hourly), range(168) t(hour))
    SELECT g.user_id, CAST(g.hour AS INT) AS hour, {r("COALESCE(h.click, 0)")} AS click, {r("COALESCE(h.view, 0)")} AS view
    FROM grid g LEFT JOIN hourly h ON g.user_id = h.user_id AND g.hour = h.hour""",
)
def dense_grid(spark, folder):
    return rounded(ts.dense_grid(hourly(spark, folder), ["user_id"], "hour", ["click", "view"], 168))


@query(
    "series_summary",
    f"""WITH {HOURLY_SQL} SELECT user_id, {", ".join(f"{r(f'AVG({c})')} AS {c}_mean, {r(f'stddev_pop({c})')} AS {c}_std" for c in TYPES)} FROM hourly GROUP BY user_id""",
)
def series_summary(spark, folder):
    return rounded(ts.series_summary(hourly(spark, folder), ["user_id"], TYPES))


@query(
    "unit_and_strict_sum",
    f"""WITH {HOURLY_SQL} SELECT user_id, hour, {r("CASE WHEN click > 50 THEN (click - 32.0) * 5.0 / 9.0 ELSE click END")} AS click_c,
    {r("click + view")} AS both_types, {r("COALESCE(purchase, signup)")} AS preferred FROM hourly""",
)
def unit_and_strict_sum(spark, folder):
    h = hourly(spark, folder)
    return rounded(
        h.select("user_id", "hour", celsius_guarded("click").alias("click_c"), strict_sum("click", "view").alias("both_types"),
                 F.coalesce("purchase", "signup").alias("preferred"))
    )
