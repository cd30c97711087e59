"""Statistical tests, pooling and interval estimates."""

import math

from pyspark.sql import functions as F

from tidemark.catalog.clinical import freetext_tables, static_features
from tidemark.catalog.descriptive import COHORT_METRICS_SQL, COHORTS_SQL
from tidemark.catalog.feedback_queries import shift_sql
from tidemark.catalog.registry import query, r, rounded, table
from tidemark.operators import stattests as st
from tidemark.plans.cohort_jobs import extract_freetext_cohort
from tidemark.plans.comparison import compare_cohorts
from tidemark.plans.report import stratified_table_one
from tidemark.session import cut_lineage

LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def halves(spark, folder):
    li = table(spark, folder, "lineitem")
    return li.where("l_linestatus = 'O'"), li.where("l_linestatus = 'F'")


def _ks_sql(name: str, a: str, b: str) -> str:
    """D of two value lists: running counts over the distinct pooled values."""
    return f"""SELECT '{name}' AS variable, CAST(MAX(n1) AS BIGINT) AS n_real, CAST(MAX(n2) AS BIGINT) AS n_synth, MAX(abs(c1 / n1 - c2 / n2)) AS ks_stat FROM (
      SELECT SUM(r) OVER w AS c1, SUM(s) OVER w AS c2, SUM(r) OVER () AS n1, SUM(s) OVER () AS n2 FROM (
        SELECT v, CAST(SUM(r) AS DOUBLE) AS r, CAST(SUM(s) AS DOUBLE) AS s FROM (SELECT v, 1 AS r, 0 AS s FROM ({a}) UNION ALL SELECT v, 0, 1 FROM ({b})) WHERE v IS NOT NULL GROUP BY v)
      WINDOW w AS (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(
    "ks_per_column",
    "SELECT variable, n_real, n_synth, " + r("ks_stat") + " AS ks_stat FROM ("
    + " UNION ALL ".join(
        [_ks_sql(c, f"SELECT {c} AS v FROM lineitem WHERE l_linestatus = 'O'", f"SELECT {c} AS v FROM lineitem WHERE l_linestatus = 'F'") for c in LINE_COLS]
        + [_ks_sql("acctbal", "SELECT c_acctbal AS v FROM customer", "SELECT s_acctbal AS v FROM supplier")]
    ) + ")",
)
def ks_per_column(spark, folder):
    real, synth = halves(spark, folder)
    lines = st.ks_tests(real, synth, LINE_COLS, p_values=False)
    c = table(spark, folder, "customer").select(F.col("c_acctbal").alias("acctbal"))
    s = table(spark, folder, "supplier").select(F.col("s_acctbal").alias("acctbal"))
    return rounded(lines.unionByName(st.ks_tests(c, s, ["acctbal"], p_values=False)))


# limit law, the default at every size
_KS_P = "LEAST(1.0, GREATEST(0.0, 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * x * x)))))"


@query(
    "ks_pvalues",
    f"SELECT variable, n_real, n_synth, {r('ks_stat')} AS ks_stat, {r(_KS_P)} AS pvalue FROM (SELECT *, ks_stat * sqrt(n_real * CAST(n_synth AS DOUBLE) / (n_real + n_synth)) AS x FROM ("
    + " UNION ALL ".join(_ks_sql(c, f"SELECT {c} AS v FROM lineitem WHERE l_linestatus = 'O'", f"SELECT {c} AS v FROM lineitem WHERE l_linestatus = 'F'") for c in LINE_COLS)
    + "))",
)
def ks_pvalues(spark, folder):
    real, synth = halves(spark, folder)
    return rounded(st.ks_tests(real, synth, LINE_COLS))


@query("window_shift", shift_sql("SELECT event_type AS w, value AS v, CAST(ts < DATE '2024-01-16' AS INT) AS r FROM events", "event_type"))
def window_shift(spark, folder):
    """Distribution shift of event values per type, first half of the period against the second."""
    ev = table(spark, folder, "events")
    day = F.to_date("ts") < F.lit("2024-01-16").cast("date")
    return rounded(st.distribution_shift(ev.where(day), ev.where(~day), ["value"], ["event_type"]))


_RANKED = """ranked AS (SELECT o_orderpriority AS g, AVG(rn) OVER (PARTITION BY o_totalprice) AS rk, o_totalprice AS v
  FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY o_totalprice) AS rn FROM orders)),
ties AS (SELECT SUM(t * t * t - t) AS t FROM (SELECT CAST(COUNT(*) AS DOUBLE) AS t FROM orders GROUP BY o_totalprice)),
n AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM orders)"""
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "kruskal_wallis",
    f"""WITH {_RANKED} SELECT 'o_totalprice' AS variable, CAST(n AS BIGINT) AS n, {r("(12.0 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n * n * n - n))", 5)} AS statistic, 4 AS df
    FROM (SELECT SUM(rs * rs / c) AS s FROM (SELECT SUM(rk) AS rs, COUNT(*) AS c FROM ranked GROUP BY g)), ties, n""",
)
def kruskal_wallis(spark, folder):
    return rounded(st.kruskal_wallis(table(spark, folder, "orders"), ["o_totalprice"], "o_orderpriority", PRIORITIES, p_values=False), 5)


_MANN_WHITNEY = """x AS (SELECT * FROM lineitem WHERE l_returnflag IN ('A', 'R')),
    rk AS (SELECT l_returnflag AS g, AVG(rn) OVER (PARTITION BY l_quantity) AS rk FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY l_quantity) AS rn FROM x)),
    t AS (SELECT SUM(t * t * t - t) AS t FROM (SELECT CAST(COUNT(*) AS DOUBLE) AS t FROM x GROUP BY l_quantity)),
    a AS (SELECT CAST(SUM(CASE WHEN g = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS n1, CAST(SUM(CASE WHEN g = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n2, SUM(CASE WHEN g = 'A' THEN rk END) AS r1 FROM rk),
    u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u1, CAST(n1 + n2 AS DOUBLE) AS n FROM a),
    mw AS (SELECT n1, n2, u1, (GREATEST(u1, CAST(n1 AS DOUBLE) * n2 - u1) - CAST(n1 AS DOUBLE) * n2 / 2 - 0.5) / sqrt(CAST(n1 AS DOUBLE) * n2 / 12 * ((n + 1) - t / (n * (n - 1)))) AS z FROM u, t)"""


@query("mann_whitney", f"WITH {_MANN_WHITNEY} SELECT 'l_quantity' AS variable, n1, n2, {r('u1', 3)} AS u, {r('z', 3)} AS z FROM mw")
def mann_whitney(spark, folder):
    return rounded(st.mann_whitney(table(spark, folder, "lineitem"), ["l_quantity"], "l_returnflag", "A", "R", p_values=False), 3)


_CELLS = """cells AS (SELECT variable, category, g, CAST(COUNT(*) AS DOUBLE) AS o FROM (
  SELECT 'o_orderpriority' AS variable, o_orderpriority AS category, o_orderstatus AS g FROM orders
  UNION ALL SELECT 'urgent', CAST(o_orderpriority = '1-URGENT' AS VARCHAR), o_orderstatus FROM orders) GROUP BY ALL)"""


@query(
    "chi_square",
    f"""WITH {_CELLS}, m AS (SELECT *, SUM(o) OVER (PARTITION BY variable, category) AS rr, SUM(o) OVER (PARTITION BY variable, g) AS cc, SUM(o) OVER (PARTITION BY variable) AS n FROM cells)
    SELECT variable, CAST(MAX(n) AS BIGINT) AS n, {r("SUM((o - rr * cc / n) * (o - rr * cc / n) / (rr * cc / n))")} AS statistic,
      CAST((COUNT(DISTINCT category) - 1) * (COUNT(DISTINCT g) - 1) AS INT) AS df FROM m GROUP BY variable""",
)
def chi_square(spark, folder):
    o = table(spark, folder, "orders").withColumn("urgent", (F.col("o_orderpriority") == "1-URGENT").cast("string"))
    return rounded(st.chi_square(o, ["o_orderpriority", "urgent"], "o_orderstatus", p_values=False))


@query(
    "chi_square_2x2",
    f"""WITH x AS (SELECT CAST(l_quantity > 25 AS INT) AS a, l_linestatus AS g FROM lineitem),
    c AS (SELECT a, g, CAST(COUNT(*) AS DOUBLE) AS o FROM x GROUP BY a, g),
    m AS (SELECT *, SUM(o) OVER (PARTITION BY a) * SUM(o) OVER (PARTITION BY g) / SUM(o) OVER () AS e FROM c)
    SELECT 'bulk' AS variable, CAST(SUM(o) AS BIGINT) AS n, {r("SUM((abs(o - e) - LEAST(0.5, abs(o - e))) ** 2 / e)")} AS statistic, 1 AS df FROM m""",
)
def chi_square_2x2(spark, folder):
    li = table(spark, folder, "lineitem").withColumn("bulk", (F.col("l_quantity") > 25).cast("int"))
    return rounded(st.chi_square(li, ["bulk"], "l_linestatus", p_values=False))


_WELCH = f"""SELECT variable, (m1 - m2) / sqrt(a + b) AS statistic, (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1)) AS df FROM ({
      " UNION ALL ".join(f'''SELECT '{c}' AS variable, AVG({c}) FILTER (l_linestatus = 'O') AS m1, AVG({c}) FILTER (l_linestatus = 'F') AS m2,
        var_samp({c}) FILTER (l_linestatus = 'O') / COUNT({c}) FILTER (l_linestatus = 'O') AS a, var_samp({c}) FILTER (l_linestatus = 'F') / COUNT({c}) FILTER (l_linestatus = 'F') AS b,
        COUNT({c}) FILTER (l_linestatus = 'O') AS n1, COUNT({c}) FILTER (l_linestatus = 'F') AS n2 FROM lineitem''' for c in LINE_COLS)})"""


@query("welch_t", f"SELECT variable, {r('statistic')} AS statistic, {r('df', 3)} AS df FROM ({_WELCH})")
def welch_t(spark, folder):
    w = st.welch(table(spark, folder, "lineitem"), LINE_COLS, "l_linestatus", "O", "F", p_values=False)
    return rounded(w.select("variable", "statistic")).join(rounded(w.select("variable", "df"), 3), "variable")


def _chi_tail(x: str, half_df: int) -> str:
    """Upper tail of chi-square for an even number of degrees of freedom."""
    terms = " + ".join(f"({x} / 2) ** {i} / {math.factorial(i)}" for i in range(half_df))
    return f"exp(-({x}) / 2) * ({terms})"


@query(
    "chi_tail_pvalues",
    f"""WITH {_RANKED}, {_CELLS}, m AS (SELECT *, SUM(o) OVER (PARTITION BY variable, category) AS rr, SUM(o) OVER (PARTITION BY variable, g) AS cc, SUM(o) OVER (PARTITION BY variable) AS n FROM cells),
    h AS (SELECT (12.0 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS x FROM (SELECT SUM(rs * rs / c) AS s FROM (SELECT SUM(rk) AS rs, COUNT(*) AS c FROM ranked GROUP BY g)), ties, n),
    c AS (SELECT variable, SUM((o - rr * cc / n) * (o - rr * cc / n) / (rr * cc / n)) AS x FROM m GROUP BY variable)
    SELECT variable, {r("p")} AS pvalue, CASE WHEN p < 0.001 THEN '<0.001' ELSE printf('%.3f', p) END AS printed FROM (
      SELECT 'o_totalprice' AS variable, {_chi_tail("x", 2)} AS p FROM h
      UNION ALL SELECT variable, {_chi_tail("x", 4)} FROM c WHERE variable = 'o_orderpriority'
      UNION ALL SELECT variable, {_chi_tail("x", 1)} FROM c WHERE variable = 'urgent')""",
)
def chi_tail_pvalues(spark, folder):
    o = table(spark, folder, "orders").withColumn("urgent", (F.col("o_orderpriority") == "1-URGENT").cast("string"))
    a = st.kruskal_wallis(o, ["o_totalprice"], "o_orderpriority", PRIORITIES)
    b = st.chi_square(o, ["o_orderpriority", "urgent"], "o_orderstatus")
    both = a.select("variable", "pvalue").unionByName(b.select("variable", "pvalue"))
    return rounded(both.withColumn("printed", st.p_text(F.col("pvalue"))))


def _simpson_p(front: str, density: str, end: int) -> str:
    """Twice the upper tail at z >= 0: one less twice the area from 0, by Simpson's rule; beyond ``end`` it prints as 0."""
    return f"""CASE WHEN z > {end} THEN 0.0 ELSE GREATEST(0.0, 1 - 2 * {front} * z / 6000 * list_sum(
      [CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * {density} for k in range(0, 2001)])) END"""


_NORMAL_P = _simpson_p("1 / sqrt(2 * pi())", "exp(-((z * k / 2000) ** 2) / 2)", 8)
_T_P = _simpson_p("exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi())", "(1 + (z * k / 2000) ** 2 / df) ** (-(df + 1) / 2)", 40)


@query(
    "rank_test_pvalues",
    f"""WITH {_MANN_WHITNEY}, p AS (SELECT 'mann_whitney' AS test, 'l_quantity' AS variable, {_NORMAL_P} AS p FROM (SELECT GREATEST(z, 0.0) AS z FROM mw)
      UNION ALL SELECT 'welch', variable, {_T_P} FROM (SELECT variable, abs(statistic) AS z, df FROM ({_WELCH})))
    SELECT test, variable, {r("p")} AS pvalue, CASE WHEN p < 0.001 THEN '<0.001' ELSE printf('%.3f', p) END AS printed FROM p""",
)
def rank_test_pvalues(spark, folder):
    """p-values that need the normal and t tails, with their printed form."""
    li = table(spark, folder, "lineitem")
    parts = [
        ("mann_whitney", st.mann_whitney(li, ["l_quantity"], "l_returnflag", "A", "R")),
        ("welch", st.welch(li, LINE_COLS, "l_linestatus", "O", "F")),
    ]
    out = None
    for name, d in parts:
        d = d.select(F.lit(name).alias("test"), "variable", "pvalue", st.p_text(F.col("pvalue")).alias("printed"))
        out = d if out is None else out.unionByName(d)
    return rounded(out)


def _metric_rows(spark, folder):
    li = table(spark, folder, "lineitem")
    per = li.groupBy((F.col("l_orderkey") % 10).alias("dataset_id")).agg(
        F.avg("l_quantity").alias("mean_quantity"), F.avg("l_discount").alias("mean_discount"),
        (F.var_samp("l_quantity") / F.count("l_quantity")).alias("vq"), (F.var_samp("l_discount") / F.count("l_discount")).alias("vd"),
    )
    return per.select("dataset_id", F.explode(F.array(
        F.struct(F.lit("mean_quantity").alias("metric"), F.col("mean_quantity").alias("value"), F.col("vq").alias("variance")),
        F.struct(F.lit("mean_discount").alias("metric"), F.col("mean_discount").alias("value"), F.col("vd").alias("variance")),
        F.struct(F.lit("undefined").alias("metric"), F.lit(float("nan")).alias("value"), F.lit(None).cast("double").alias("variance")),
    )).alias("e")).select("dataset_id", "e.*")


_POOL_SQL = """per AS (SELECT l_orderkey % 10 AS d, AVG(l_quantity) AS q, var_samp(l_quantity) / COUNT(*) AS vq, AVG(l_discount) AS s, var_samp(l_discount) / COUNT(*) AS vs FROM lineitem GROUP BY 1),
long AS (SELECT 'mean_quantity' AS metric, q AS v, vq AS u FROM per UNION ALL SELECT 'mean_discount', s, vs FROM per),
pool AS (SELECT metric, COUNT(*) AS m, AVG(v) AS pooled_estimate, var_samp(v) AS between_variance, AVG(u) AS within_variance FROM long GROUP BY metric)"""


@query(
    "rubin_pool",
    f"""WITH {_POOL_SQL} SELECT metric, m, {r("pooled_estimate", 9)} AS pooled_estimate, {r("between_variance", 9)} AS between_variance, {r("within_variance", 9)} AS within_variance,
       {r("within_variance / m + (1 + 1.0 / m) * between_variance", 9)} AS total_variance FROM pool
    UNION ALL SELECT 'undefined', 0, NULL, 0.0, 0.0, NULL""",
)
def rubin_pool(spark, folder):
    return rounded(st.rubin_pool(_metric_rows(spark, folder), ["metric"], "value", "variance", intervals=False), 9)


@query(
    "rubin_intervals",
    # no within variance: nu = (m - 1) * 4 = 36 for ten datasets, t quantile 2.028094
    f"""WITH {_POOL_SQL} SELECT metric, m, printf('%.4f [%.4f, %.4f]', pooled_estimate, pooled_estimate - 2.0280940009804502 * sqrt(1.1 * between_variance),
       pooled_estimate + 2.0280940009804502 * sqrt(1.1 * between_variance)) AS pooled FROM pool UNION ALL SELECT 'undefined', 0, ''""",
)
def rubin_intervals(spark, folder):
    p = st.rubin_pool(_metric_rows(spark, folder), ["metric"])
    return p.select("metric", "m", st.pooled_text(F.col("pooled_estimate"), F.col("ci_lower"), F.col("ci_upper")).alias("pooled"))


@query(
    "prediction_interval",
    f"""SELECT event_type, {r("AVG(value) - 1.959963984540054 * stddev_pop(value)")} AS lower, {r("AVG(value) + 1.959963984540054 * stddev_pop(value)")} AS upper FROM events GROUP BY event_type""",
)
def prediction_interval(spark, folder):
    m = table(spark, folder, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    lo, hi = st.gaussian_interval(F.col("m"), F.col("s"))
    return rounded(m.select("event_type", lo.alias("lower"), hi.alias("upper")))


def _two_by_two(name: str, flag: str) -> str:
    """Corrected chi-square of a 0/1 flag against the source, with the square root as a normal statistic."""
    return f"""SELECT '{name}' AS test, sqrt(SUM((abs(o - e) - LEAST(0.5, abs(o - e))) ** 2 / e)) AS z FROM (
      SELECT o, SUM(o) OVER (PARTITION BY f) * SUM(o) OVER (PARTITION BY source) / SUM(o) OVER () AS e FROM (
        SELECT {flag} AS f, source, CAST(COUNT(*) AS DOUBLE) AS o FROM b WHERE {flag} IS NOT NULL GROUP BY ALL))"""


COHORT_TESTS_SQL = f"""WITH {COHORTS_SQL}, m AS ({COHORT_METRICS_SQL}),
  age AS (SELECT source, AVG(age) AS m, var_samp(age) / COUNT(age) AS v, COUNT(age) AS n FROM b GROUP BY source),
  los AS (SELECT source, los, AVG(rn) OVER (PARTITION BY los) AS rk FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY los) AS rn FROM b WHERE los IS NOT NULL)),
  lt AS (SELECT SUM(t * t * t - t) AS t FROM (SELECT CAST(COUNT(*) AS DOUBLE) AS t FROM los GROUP BY los)),
  ls AS (SELECT CAST(COUNT(*) FILTER (source = 'primary') AS DOUBLE) AS n1, CAST(COUNT(*) FILTER (source = 'external') AS DOUBLE) AS n2, SUM(rk) FILTER (source = 'primary') AS r1 FROM los),
  lu AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM ls),
  z AS ({_two_by_two("gender", "CAST(COALESCE(gender IN ('M', 'Male'), FALSE) AS INT)")} UNION ALL {_two_by_two("mortality", "CAST(dead AS INT)")}
    UNION ALL SELECT 'los', GREATEST(0.0, (GREATEST(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - t / (n * (n - 1))))) FROM lu, lt),
  p AS (SELECT test, {_NORMAL_P} AS p FROM z UNION ALL SELECT 'anchor_age', {_T_P} FROM (
    SELECT abs(x.m - y.m) / sqrt(x.v + y.v) AS z, (x.v + y.v) ** 2 / (x.v * x.v / (x.n - 1) + y.v * y.v / (y.n - 1)) AS df FROM age x, age y WHERE x.source = 'primary' AND y.source = 'external'))
  SELECT w.*, round(p, 4) AS p_value FROM (SELECT metric, round(MAX(v) FILTER (source = 'primary'), 1) AS "primary", round(MAX(v) FILTER (source = 'external'), 1) AS "external" FROM m GROUP BY metric) w
  LEFT JOIN p ON p.test = CASE WHEN metric IN ('age_mean', 'age_std', 'age_median') THEN 'anchor_age' WHEN metric = 'pct_male' THEN 'gender'
    WHEN metric = 'mortality_pct' THEN 'mortality' WHEN metric LIKE 'los_%' THEN 'los' END"""


@query("cohort_comparison_tests", COHORT_TESTS_SQL)
def cohort_comparison_tests(spark, folder):
    return compare_cohorts(static_features(spark, folder), extract_freetext_cohort(freetext_tables(spark, folder)))


@query("table1_with_tests")
def table1_with_tests(spark, folder):
    static = cut_lineage(static_features(spark, folder))
    return stratified_table_one(static, "stroke_subtype", ["ischemic", "ich", "sah", "tia", "other"],
                                {"gender": "Gender — F", "hospital_expire_flag": "In-hospital mortality"})
