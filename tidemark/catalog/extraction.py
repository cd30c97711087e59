"""Cohort, feature and series extraction."""

from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.catalog.clinical import (
    CHART_SQL,
    CODED_SQL,
    FREETEXT_SQL,
    coded_tables,
    freetext_tables,
    series,
    static_features,
)
from tidemark.catalog.registry import query, r, rounded, rs, table
from tidemark.functions.exprs import flag_equals, map_values, number_or_leading_digits, parse_with_sentinel, text_ladder, text_match
from tidemark.operators.cohort import best_record, code_flags, first_values_in_window, key_map, restrict_to
from tidemark.operators.prep import conform
from tidemark.operators.timeseries import hourly_medians, with_hour
from tidemark.plans.cohort_jobs import COHORT_COLUMNS, extract_cohort, extract_freetext_cohort, extract_periodic_timeseries
from tidemark.sources.writers import run_sql


@query(
    "hourly_median_pivot",
    f"""WITH starts AS (SELECT user_id, MIN(ts) AS start FROM events GROUP BY user_id),
    hourly AS (SELECT e.user_id, CAST(floor((epoch_us(ts) - epoch_us(start)) / 3600000000.0) AS INT) AS hour, event_type, MEDIAN(value) AS m
               FROM events e JOIN starts s ON e.user_id = s.user_id WHERE (epoch_us(ts) - epoch_us(start)) / 3600000000.0 < 721 GROUP BY ALL),
    wide AS (SELECT user_id, hour, {", ".join(f"MAX(CASE WHEN event_type = '{t}' THEN m END) AS {t}_value" for t in ("click", "error", "purchase", "signup", "view"))}
             FROM hourly GROUP BY ALL)
    SELECT user_id, hour, {rs("w", "click_value", "error_value", "purchase_value", "signup_value", "view_value")},
           {r("COALESCE(click_value, view_value)")} AS preferred FROM wide w""",
)
def hourly_median_pivot(spark, folder):
    ev = table(spark, folder, "events")
    starts = ev.groupBy("user_id").agg(F.min("ts").alias("start"))
    rows = with_hour(ev.select("user_id", "ts", "event_type", "value"), starts, "user_id", "ts", "start", 720)
    items = {t: f"{t}_value" for t in ("click", "error", "purchase", "signup", "view")}
    wide = hourly_medians(rows, ["user_id", "hour"], "event_type", items, "value")
    return rounded(wide.withColumn("preferred", F.coalesce("click_value", "view_value")))


@query(
    "first_stay_cohort",
    f"""WITH {CODED_SQL} SELECT {", ".join(f"{r('los')} AS los" if c == "los" else c for c in COHORT_COLUMNS)} FROM cohort""",
)
def first_stay_cohort(spark, folder):
    return rounded(extract_cohort(coded_tables(spark, folder)))


@query(
    "static_features",
    f"""WITH {CODED_SQL} SELECT subject_id, hadm_id, icd_code, icd_version, {r("los")} AS los,
    has_hypertension, has_diabetes, has_afib, has_dyslipidemia, has_ckd, has_cad, stroke_subtype,
    {rs("s", *vocab.LAB_COLUMNS)} FROM static s""",
)
def static_features_query(spark, folder):
    keep = ["subject_id", "hadm_id", "icd_code", "icd_version", "los", *vocab.COMORBIDITY_PREFIXES, "stroke_subtype", *vocab.LAB_COLUMNS]
    return rounded(static_features(spark, folder).select(*keep))


@query(
    "hourly_series",
    f"""WITH {CHART_SQL} SELECT subject_id, stay_id, hour, {rs("s", *vocab.CHANNELS)} FROM series s""",
)
def hourly_series(spark, folder):
    return rounded(series(spark, folder))


@query("freetext_cohort", f"WITH {FREETEXT_SQL} SELECT * REPLACE ({r('los')} AS los) FROM external")
def freetext_cohort(spark, folder):
    return rounded(extract_freetext_cohort(freetext_tables(spark, folder)))


_PERIODIC = {"heartrate": "click", "systemicsystolic": "view", "systemicdiastolic": "error", "systemicmean": "signup",
             "respiration": "purchase", "sao2": "click", "temperature": "view"}


@query(
    "periodic_series",
    f"""WITH ids AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 150),
    v AS (SELECT user_id, CAST((event_id * 7) % 6000 - 60 AS INT) AS off,
          {", ".join(f"CASE WHEN event_type <> '{s}' THEN value END AS {c}" for c, s in _PERIODIC.items())} FROM events),
    h AS (SELECT v.user_id AS subject_id, v.user_id AS stay_id, CAST(floor(off / 60.0) AS INT) AS hour, MEDIAN(heartrate) AS hr,
          MEDIAN(systemicsystolic) AS sbp, MEDIAN(systemicdiastolic) AS dbp, MEDIAN(systemicmean) AS map, MEDIAN(respiration) AS rr,
          MEDIAN(sao2) AS spo2, MEDIAN(temperature) AS t FROM v JOIN ids ON v.user_id = ids.user_id
          WHERE off >= 0 AND floor(off / 60.0) <= 72 GROUP BY ALL),
    g AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 4 + 1 END AS eyes, o_orderkey % 6 + 1 AS motor, o_orderkey % 5 + 1 AS verbal FROM orders)
    SELECT subject_id, stay_id, hour, {rs("h", "hr", "sbp", "dbp", "map", "rr", "spo2")},
      {r("CASE WHEN t > 50 THEN (t - 32.0) * 5.0 / 9.0 ELSE t END")} AS temp_c,
      {r("eyes")} AS gcs_eye, {r("verbal")} AS gcs_verbal, {r("motor")} AS gcs_motor, {r("eyes + motor + verbal")} AS gcs_total
    FROM h LEFT JOIN g ON h.stay_id = g.k""",
)
def periodic_series(spark, folder):
    t = freetext_tables(spark, folder)
    cohort = (
        table(spark, folder, "events").where("event_type = 'signup' AND value > 150")
        .select(F.col("user_id").alias("hadm_id"), F.col("user_id").alias("subject_id")).distinct()
    )
    return rounded(extract_periodic_timeseries(cohort, t["vitals"], t["gcs"], 72))


@query(
    "freetext_subtype",
    """SELECT doc_id, CASE WHEN lower(text) LIKE '%license%' THEN 'license' WHEN lower(text) LIKE '%http%' OR lower(text) LIKE '%www.%' THEN 'link'
       WHEN lower(text) LIKE '%the %' THEN 'english' ELSE 'other' END AS subtype
       FROM documents WHERE lower(text) LIKE '%tion%' OR lower(text) LIKE '%license%' OR lower(text) LIKE '%www.%' OR lower(text) LIKE '% er%'""",
)
def freetext_subtype(spark, folder):
    docs = table(spark, folder, "documents").where(text_match("text", ["tion", "license", "www.", " er"]))
    ladder = [("license", ["license"]), ("link", ["http", "www."]), ("english", ["the "])]
    return docs.select("doc_id", text_ladder("text", ladder, "other").alias("subtype"))


@query(
    "sentinel_parse",
    f"""SELECT event_id, CASE WHEN k = '89' THEN 90 ELSE TRY_CAST(k AS INTEGER) END AS parsed,
       {r("CASE WHEN event_type = 'view' THEN value WHEN regexp_matches(k || ' units', '^\\d+') THEN CAST(regexp_extract(k || ' units', '^(\\d+)', 1) AS DOUBLE) END")} AS reading,
       CASE WHEN lower(event_type) = 'error' THEN 1 ELSE 0 END AS flag,
       CASE event_type WHEN 'click' THEN 'C' WHEN 'view' THEN 'V' ELSE event_type END AS kind
       FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events) WHERE TRY_CAST(k AS INTEGER) >= 18 OR k = '89'""",
)
def sentinel_parse(spark, folder):
    ev = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k"))
    number = F.when(F.col("event_type") == "view", F.col("value"))
    return rounded(
        ev.where((F.col("k").try_cast("int") >= 18) | (F.col("k") == "89")).select(
            "event_id",
            parse_with_sentinel("k", "89", 90).alias("parsed"),
            number_or_leading_digits(number, F.concat("k", F.lit(" units"))).alias("reading"),
            flag_equals("event_type", "error").alias("flag"),
            map_values("event_type", {"click": "C", "view": "V"}).alias("kind"),
        )
    )


_TYPES = {"has_promo": "PROMO", "has_economy": "ECON", "has_large": "LARGE"}


@query(
    "comorbidity_flags",
    f"""SELECT o_orderkey, {", ".join(f"CAST(MAX(CASE WHEN p_type LIKE '{v}%' THEN 1 ELSE 0 END) AS INT) AS {k}" for k, v in _TYPES.items())}
    FROM orders LEFT JOIN (SELECT l_orderkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey) d ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
)
def comorbidity_flags(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_type")
    codes = table(spark, folder, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("p_type").alias("icd_code"), F.lit(1).alias("icd_version")
    )
    return code_flags(table(spark, folder, "orders").select("o_orderkey"), codes, ["o_orderkey"], {k: {1: [v]} for k, v in _TYPES.items()})


@query(
    "first_window_value_pivot",
    f"""SELECT o_orderkey, {", ".join(f"{r(f'MAX(CASE WHEN l_returnflag = {chr(39)}{f}{chr(39)} THEN l_quantity END)')} AS first_{f.lower()}" for f in "ANR")} FROM (
      SELECT o_orderkey, l_returnflag, l_quantity, ROW_NUMBER() OVER (PARTITION BY o_orderkey, l_returnflag
        ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 365 DAY)
    WHERE rn = 1 GROUP BY o_orderkey""",
)
def first_window_value_pivot(spark, folder):
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    items = {f: f"first_{f.lower()}" for f in "ANR"}
    return rounded(
        first_values_in_window(
            table(spark, folder, "orders"), lines, ["o_orderkey"], "o_orderdate", "365 DAYS", "l_returnflag", items,
            "l_quantity", "l_shipdate", ["l_linenumber", "l_partkey", "l_suppkey"],
        )
    )


@query(
    "best_record_desc_nulls_last",
    """SELECT o_custkey, o_orderkey, best_price, urgent FROM (
         SELECT o_custkey, o_orderkey, p AS best_price, CASE WHEN lower(o_orderpriority) = '1-urgent' THEN 1 ELSE 0 END AS urgent,
                ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY p DESC NULLS LAST, o_orderkey) AS rn
         FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS p FROM orders)) WHERE rn = 1""",
)
def best_record_desc_nulls_last(spark, folder):
    orders = table(spark, folder, "orders").withColumn("best_price", F.expr("CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END"))
    best = best_record(orders, "o_custkey", "best_price", ["o_orderkey"])
    return best.select("o_custkey", "o_orderkey", "best_price", flag_equals("o_orderpriority", "1-URGENT".lower()).alias("urgent"))


@query(
    "semi_join_key_map",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, o_custkey, CAST(NULL AS VARCHAR) AS note
       FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
       WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND p_size >= 40)""",
)
def semi_join_key_map(spark, folder):
    wanted = table(spark, folder, "part").where("p_type = 'PROMO' AND p_size >= 40").select(F.col("p_partkey").alias("l_partkey"))
    lines = restrict_to(table(spark, folder, "lineitem"), wanted, ["l_partkey"])
    orders = table(spark, folder, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    schema = {"l_orderkey": "long", "l_linenumber": "int", "l_partkey": "long", "l_suppkey": "long", "l_quantity": "double",
              "o_custkey": "long", "note": "string"}
    return conform(key_map(lines, orders, "l_orderkey", "o_custkey"), schema)


@query(
    "parameterised_sql",
    f"""SELECT n_name, COUNT(*) AS n_orders, {r("SUM(o_totalprice)", 2)} AS total FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice >= 1000 / 24.0 * 24 AND o_totalprice <= 250000 GROUP BY n_name""",
)
def parameterised_sql(spark, folder):
    text = """SELECT n_name, COUNT(*) AS n_orders, SUM(o_totalprice) AS total FROM {orders} JOIN {customer} ON o_custkey = c_custkey
              JOIN {nation} ON c_nationkey = n_nationkey WHERE o_totalprice >= :lo / 24.0 * 24 AND o_totalprice <= :hi GROUP BY n_name"""
    tables = {t: table(spark, folder, t) for t in ("orders", "customer", "nation")}
    return rounded(run_sql(spark, text, tables, lo=1000, hi=250000), 2)
