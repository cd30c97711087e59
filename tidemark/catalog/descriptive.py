"""Profiles, Table 1, rates, trajectories, correlations."""

from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.catalog.clinical import CODED_SQL, FREETEXT_SQL, coded_tables, freetext_tables, static_features
from tidemark.catalog.preparation import LABELLED_SQL, labelled
from tidemark.catalog.registry import query, r, rounded, rs, table
from tidemark.catalog.series_queries import HOURLY_SQL, TYPES, hourly
from tidemark.functions.exprs import bin_label
from tidemark.operators import profiles
from tidemark.plans.cohort_jobs import extract_cohort, extract_freetext_cohort
from tidemark.plans.comparison import cohort_metrics, stack_cohorts
from tidemark.plans.report import default_rows

LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _profile_sql(source: str, cols, group: str = "") -> str:
    g = f"{group}, " if group else ""
    return " UNION ALL ".join(
        f"""SELECT {g}'{c}' AS variable, COUNT({c}) AS n, COUNT(*) - COUNT({c}) AS missing, {r(f"100.0 * (COUNT(*) - COUNT({c})) / COUNT(*)")} AS missing_pct,
        {r(f"AVG({c})")} AS mean, {r(f"stddev_samp({c})")} AS sd, {r(f"MIN({c})")} AS min, {r(f"quantile_cont({c}, 0.25)")} AS q1,
        {r(f"quantile_cont({c}, 0.5)")} AS median, {r(f"quantile_cont({c}, 0.75)")} AS q3, {r(f"MAX({c})")} AS max FROM {source} {"GROUP BY " + group if group else ""}"""
        for c in cols
    )


@query("numeric_profile", _profile_sql("lineitem", LINE_COLS))
def numeric_profile(spark, folder):
    return rounded(profiles.numeric_profile(table(spark, folder, "lineitem"), LINE_COLS))


@query("numeric_profile_missing", f"WITH {LABELLED_SQL} " + _profile_sql("labelled", ["n_chars", "quality", "toxic"], "lang"))
def numeric_profile_missing(spark, folder):
    return rounded(profiles.numeric_profile(labelled(spark, folder), ["n_chars", "quality", "toxic"], ["lang"]))


@query(
    "category_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, {c} AS category, COUNT(*) AS n, {r('100.0 * COUNT(*) / (SELECT COUNT(*) FROM orders)')} AS pct FROM orders GROUP BY {c}"
        for c in ("o_orderstatus", "o_orderpriority")
    ),
)
def category_profile(spark, folder):
    return rounded(profiles.category_profile(table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"]))


@query(
    "binary_profile",
    f"WITH {LABELLED_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, CAST(SUM({c}) AS BIGINT) AS n, {r(f'100.0 * SUM({c}) / COUNT(*)')} AS pct FROM labelled" for c in ("quality", "toxic")
    ),
)
def binary_profile(spark, folder):
    return rounded(profiles.binary_profile(labelled(spark, folder), ["quality", "toxic"]))


@query(
    "missing_rates",
    f"WITH {HOURLY_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS variable, {r(f'100.0 * AVG(CAST({c} IS NULL AS INT))')} AS missing_pct FROM hourly" for c in TYPES),
)
def missing_rates(spark, folder):
    return rounded(profiles.missing_rates(hourly(spark, folder), TYPES))


@query(
    "distinct_counts",
    "SELECT COUNT(DISTINCT l_orderkey) AS orders, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS suppliers, COUNT(*) AS n FROM lineitem",
)
def distinct_counts(spark, folder):
    return table(spark, folder, "lineitem").agg(
        F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_partkey").alias("parts"),
        F.countDistinct("l_suppkey").alias("suppliers"), F.count(F.lit(1)).alias("n"),
    )


@query("top_categories", "SELECT source AS category, COUNT(*) AS n FROM documents GROUP BY source ORDER BY n DESC, category LIMIT 8")
def top_categories(spark, folder):
    return profiles.top_categories(table(spark, folder, "documents"), "source", 8)


@query(
    "group_mean",
    f"SELECT o_orderpriority, COUNT(*) AS n, {r('AVG(CAST(o_orderstatus = CHR(70) AS INT))')} AS mean_filled FROM orders GROUP BY o_orderpriority",
)
def group_mean(spark, folder):
    o = table(spark, folder, "orders").withColumn("filled", (F.col("o_orderstatus") == "F").cast("int"))
    return rounded(profiles.group_mean(o, ["o_orderpriority"], ["filled"]))


_EDGES = [0, 100000, 200000, 300000, 400000, 500000]


@query(
    "binned_rate_ci",
    f"""SELECT bin, COUNT(*) AS n, {r("100.0 * AVG(f)")} AS rate, {r("196.0 * sqrt(AVG(f) * (1 - AVG(f)) / COUNT(*))")} AS ci FROM (
      SELECT 'b' || CAST(ceil(o_totalprice / 100000) AS INT) AS bin, CAST(o_orderstatus = 'F' AS DOUBLE) AS f FROM orders WHERE o_totalprice > 0 AND o_totalprice <= 500000)
    GROUP BY bin""",
)
def binned_rate_ci(spark, folder):
    o = table(spark, folder, "orders").withColumn("filled", (F.col("o_orderstatus") == "F").cast("int"))
    bins = bin_label("o_totalprice", _EDGES, [f"b{i}" for i in range(1, 6)], right_closed=True)
    return rounded(profiles.binned_rate(o, bins, "filled"))


@query(
    "prevalence_by_bin",
    f"""WITH {CODED_SQL} SELECT CASE WHEN anchor_age <= 50 THEN '<50' WHEN anchor_age <= 65 THEN '50-64' WHEN anchor_age <= 80 THEN '65-79' ELSE '80+' END AS bin,
    COUNT(*) AS n, {", ".join(f"{r(f'100.0 * AVG({c})')} AS {c}" for c in vocab.COMORBIDITY_LABELS)} FROM static WHERE anchor_age > 0 GROUP BY 1""",
)
def prevalence_by_bin(spark, folder):
    bins = bin_label("anchor_age", *vocab.AGE_GROUPS, right_closed=True)
    return rounded(profiles.prevalence_by_bin(static_features(spark, folder), bins, list(vocab.COMORBIDITY_LABELS)))


@query(
    "trajectory_mean_ci",
    f"""WITH {HOURLY_SQL}, h AS (SELECT h.*, CASE WHEN c_acctbal > 4500 THEN 'rich' ELSE 'poor' END AS grp FROM hourly h JOIN customer ON user_id = c_custkey WHERE hour <= 72)
    SELECT * FROM ({" UNION ALL ".join(f"SELECT grp, hour, '{c}' AS channel, COUNT({c}) AS n, {r(f'AVG({c})')} AS mean, {r(f'1.96 * stddev_samp({c}) / sqrt(COUNT({c}))')} AS ci FROM h GROUP BY grp, hour" for c in ("click", "view"))}) WHERE n > 0""",
)
def trajectory_mean_ci(spark, folder):
    dims = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), F.when(F.col("c_acctbal") > 4500, "rich").otherwise("poor").alias("grp")
    )
    return rounded(profiles.trajectory_mean(hourly(spark, folder).join(dims, "user_id"), ["grp"], "hour", ["click", "view"], 72))


_PAIRS = [("low_tax", "l_tax < 0.04"), ("discounted", "l_discount > 0.05"), ("bulk", "l_quantity >= 25")]


@query(
    "cooccurrence_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {r(f'100.0 * SUM(CAST(({x}) AND ({y}) AS INT)) / COUNT(*)')} AS pct FROM lineitem" for a, x in _PAIRS for b, y in _PAIRS
    ),
)
def cooccurrence_matrix(spark, folder):
    li = table(spark, folder, "lineitem").select(*[F.expr(f"CAST({e} AS INT)").alias(n) for n, e in _PAIRS])
    return rounded(profiles.cooccurrence(li, [n for n, _ in _PAIRS]))


def _corr_sql(source: str, cols, where: str = "TRUE") -> str:
    parts = []
    for a in cols:
        for b in cols:
            ok = f"{a} IS NOT NULL AND {b} IS NOT NULL AND {where}"
            parts.append(
                f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) ELSE 0 END AS r FROM {source} WHERE {ok}"
            )
    return " UNION ALL ".join(parts)


@query(
    "corr_matrix",
    f"WITH x AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, 1.5 AS flat FROM lineitem) SELECT a, b, {r('r')} AS r FROM ({_corr_sql('x', [*LINE_COLS, 'flat'])})",
)
def corr_matrix(spark, folder):
    li = table(spark, folder, "lineitem").withColumn("flat", F.lit(1.5))
    return rounded(profiles.correlations(li, [*LINE_COLS, "flat"]))


@query(
    "corr_matrix_missing",
    f"WITH {LABELLED_SQL} SELECT a, b, {r('r')} AS r FROM ({_corr_sql('labelled', ['n_chars', 'quality', 'toxic'])})",
)
def corr_matrix_missing(spark, folder):
    return rounded(profiles.correlations(labelled(spark, folder), ["n_chars", "quality", "toxic"]))


@query(
    "histogram",
    f"""SELECT CAST(LEAST(floor((c_acctbal + 1000) / 275.0), 39) AS INT) AS bin, {r("-1000 + CAST(LEAST(floor((c_acctbal + 1000) / 275.0), 39) AS INT) * 275.0")} AS lo, COUNT(*) AS n
    FROM customer WHERE c_acctbal >= -1000 AND c_acctbal <= 10000 GROUP BY 1, 2""",
)
def histogram(spark, folder):
    return rounded(profiles.histogram(table(spark, folder, "customer"), "c_acctbal", -1000.0, 10000.0, 40))


@query(
    "capped_five_numbers",
    f"""WITH x AS (SELECT event_type, LEAST(value, (SELECT quantile_cont(value, 0.99) FROM events)) AS v FROM events)
    SELECT event_type, COUNT(*) AS n, {r("MIN(v)")} AS min_v, {r("quantile_cont(v, 0.25)")} AS q1_v, {r("MEDIAN(v)")} AS median_v,
      {r("quantile_cont(v, 0.75)")} AS q3_v, {r("MAX(v)")} AS max_v FROM x GROUP BY event_type""",
)
def capped_five_numbers(spark, folder):
    return rounded(profiles.capped_five_numbers(table(spark, folder, "events"), "value", "event_type", 0.99))


@query(
    "table1_by_group",
    f"""WITH {CODED_SQL}, g AS (SELECT hospital_expire_flag AS h, COUNT(*) AS n,
      SUM(CAST(gender = 'F' AS INT)) AS f, SUM(CAST(stroke_subtype = 'tia' AS INT)) AS tia, SUM(has_afib) AS afib, SUM(hospital_expire_flag) AS dead FROM static GROUP BY 1)
    SELECT h AS hospital_expire_flag, variable, statistic, value FROM (
      SELECT h, 'N' AS variable, 'n' AS statistic, CAST(n AS VARCHAR) AS value FROM g
      UNION ALL SELECT h, 'Gender — F', 'n (%)', printf('%d (%.1f%%)', f, f / n * 100.0) FROM g
      UNION ALL SELECT h, 'Stroke subtype — TIA', 'n (%)', printf('%d (%.1f%%)', tia, tia / n * 100.0) FROM g
      UNION ALL SELECT h, 'Atrial Fibrillation', 'n (%)', printf('%d (%.1f%%)', afib, afib / n * 100.0) FROM g
      UNION ALL SELECT h, 'In-hospital mortality', 'n (%)', printf('%d (%.1f%%)', dead, dead / n * 100.0) FROM g
      UNION ALL SELECT hospital_expire_flag, 'Age (years)', 'Median (IQR)', printf('%.1f (%.1f-%.1f)', MEDIAN(anchor_age), quantile_cont(anchor_age, 0.25), quantile_cont(anchor_age, 0.75)) FROM static GROUP BY 1)""",
)
def table1_by_group(spark, folder):
    static = static_features(spark, folder)
    _, levels = default_rows(static)
    wanted = {"Gender — F", "Stroke subtype — TIA", "Atrial Fibrillation", "In-hospital mortality"}
    t = profiles.table_one(static, {"anchor_age": "Age (years)"}, [x for x in levels if x[0] in wanted], ["hospital_expire_flag"])
    return t.drop("position")


COHORTS_SQL = f"""{CODED_SQL}, {FREETEXT_SQL}, b AS (
      SELECT 'primary' AS source, CAST(anchor_age AS DOUBLE) AS age, gender, CAST(hospital_expire_flag AS DOUBLE) AS dead, los, stroke_subtype AS st FROM static
      UNION ALL SELECT 'external', CAST(anchor_age AS DOUBLE), gender, CAST(hospital_expire_flag AS DOUBLE), los, stroke_subtype FROM external)"""
COHORT_METRICS_SQL = f"""
      SELECT source, 'n_patients' AS metric, CAST(COUNT(*) AS DOUBLE) AS v FROM b GROUP BY source
      UNION ALL SELECT source, 'age_mean', AVG(age) FROM b GROUP BY source
      UNION ALL SELECT source, 'age_std', stddev_samp(age) FROM b GROUP BY source
      UNION ALL SELECT source, 'age_median', MEDIAN(age) FROM b GROUP BY source
      UNION ALL SELECT source, 'pct_male', 100.0 * AVG(CAST(gender IN ('M', 'Male') AS INT)) FROM b GROUP BY source
      UNION ALL SELECT source, 'mortality_pct', 100.0 * AVG(dead) FROM b GROUP BY source
      UNION ALL SELECT source, 'los_median_days', MEDIAN(los) FROM b GROUP BY source
      UNION ALL SELECT source, 'los_iqr_25', quantile_cont(los, 0.25) FROM b GROUP BY source
      UNION ALL SELECT source, 'los_iqr_75', quantile_cont(los, 0.75) FROM b GROUP BY source
      {" ".join(f"UNION ALL SELECT source, 'subtype_{s}_pct', 100.0 * SUM(CAST(st = '{s}' AS INT)) / COUNT(st) FROM b GROUP BY source" for s in vocab.SUBTYPES)}"""


@query("cohort_comparison", f"WITH {COHORTS_SQL} SELECT source, metric, {r('v')} AS value FROM ({COHORT_METRICS_SQL})")
def cohort_comparison(spark, folder):
    ext = extract_freetext_cohort(freetext_tables(spark, folder))
    both = stack_cohorts(static_features(spark, folder), ext, ("primary", "external"))
    return rounded(cohort_metrics(both, digits=12))
