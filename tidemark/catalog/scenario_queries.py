"""Scenario contrasts by matched resampling: customers as profiles, users with events as donors."""

from pyspark.sql import functions as F

from tidemark.catalog.preparation import u_sql
from tidemark.catalog.registry import query, r, rounded, table
from tidemark.catalog.series_queries import HOURLY_SQL, hourly
from tidemark.functions.exprs import map_override
from tidemark.operators import scenario as sc
from tidemark.operators.stattests import gaussian_interval
from tidemark.session import cut_lineage

SCENARIOS = {"baseline": {}, "rich": {"band": "high"}, "other_segment": {"segment": "BUILDING", "band": "low"}}
_ATTRS = ["segment", "band"]

#: Draws per profile and scenario, and of the interval of repeated draws.
DRAWS, INTERVAL_DRAWS = 5, 30

_WITH_DRAWS = f"""{HOURLY_SQL}, series AS (SELECT * FROM hourly WHERE hour <= 72),
people AS (SELECT c_custkey AS id, c_mktsegment AS segment, CASE WHEN c_acctbal < 2500 THEN 'low' WHEN c_acctbal < 7000 THEN 'mid' ELSE 'high' END AS band FROM customer),
donors AS (SELECT * FROM people WHERE id IN (SELECT user_id FROM series)),
expanded AS (SELECT id, 'baseline' AS scenario, segment, band FROM people UNION ALL SELECT id, 'rich', segment, 'high' FROM people UNION ALL SELECT id, 'other_segment', 'BUILDING', 'low' FROM people),
dk AS (SELECT id, unnest(['2|segment=' || segment || '|band=' || band, '1|segment=' || segment, '0']) AS key FROM donors),
ranked AS (SELECT id, key, ROW_NUMBER() OVER (PARTITION BY key ORDER BY {u_sql("42", "id")}, id) AS rank, COUNT(*) OVER (PARTITION BY key) AS size FROM dk),
want AS (SELECT id, scenario, unnest([2, 1, 0]) AS matched_on, unnest(['2|segment=' || segment || '|band=' || band, '1|segment=' || segment, '0']) AS key FROM expanded),
best AS (SELECT * FROM (SELECT w.*, s.size, ROW_NUMBER() OVER (PARTITION BY w.id, scenario ORDER BY matched_on DESC) AS rn FROM want w JOIN (SELECT DISTINCT key, size FROM ranked) s ON w.key = s.key) WHERE rn = 1),
drawn AS (SELECT b.id, scenario, draw, matched_on, CAST(floor({u_sql("42", "b.id", "scenario", "draw")} * size) + 1 AS BIGINT) AS rank, key FROM best b, range(1, @draws@ + 1) t(draw)),
draws AS (SELECT d.id, d.scenario, CAST(d.draw AS INT) AS draw, CAST(d.matched_on AS INT) AS matched_on, k.id AS donor FROM drawn d JOIN ranked k ON d.key = k.key AND d.rank = k.rank),
traj AS (SELECT d.*, s.hour, s.click, s.view FROM draws d JOIN series s ON d.donor = s.user_id)"""
_BASE, _MANY = (_WITH_DRAWS.replace("@draws@", str(n)) for n in (DRAWS, INTERVAL_DRAWS))


def _people(spark, folder):
    bal = F.col("c_acctbal")
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"),
        F.when(bal < 2500, "low").when(bal < 7000, "mid").otherwise("high").alias("band"),
    )


def _series(spark, folder):
    return hourly(spark, folder).where("hour <= 72").select(F.col("user_id").alias("donor"), "hour", "click", "view")


def _draws(spark, folder, scenarios=SCENARIOS, n=DRAWS):
    people = _people(spark, folder)
    donors = people.withColumnRenamed("id", "donor").join(_series(spark, folder).select("donor").distinct(), "donor", "left_semi")
    return sc.draw_donors(sc.expand_scenarios(people, scenarios), donors, ["id", "scenario"], "donor", _ATTRS, n)


def _trajectories(spark, folder):
    return sc.conditional_trajectories(_draws(spark, folder), _series(spark, folder), "donor")


@query("scenario_expand", f"WITH {_BASE} SELECT id, scenario, segment, band FROM expanded")
def scenario_expand(spark, folder):
    return sc.expand_scenarios(_people(spark, folder), SCENARIOS)


@query("conditional_draws", f"WITH {_BASE} SELECT id, scenario, draw, matched_on, donor FROM draws")
def conditional_draws(spark, folder):
    return _draws(spark, folder)


@query(
    "scenario_compare",
    f"""WITH {_BASE} SELECT scenario, hour, {r("AVG(click)")} AS click_mean, {r("AVG(view)")} AS view_mean, {r("stddev_pop(click)")} AS click_std, {r("stddev_pop(view)")} AS view_std FROM traj GROUP BY scenario, hour""",
)
def scenario_compare(spark, folder):
    return rounded(sc.compare_scenarios(_trajectories(spark, folder), ["click", "view"]))


@query(
    "assoc_difference",
    f"""WITH {_BASE}, y AS (SELECT scenario, (COALESCE(l.click, 0) + COALESCE(l.view, 0)) / 2.0 AS y FROM (
      SELECT scenario, id, draw, arg_max({{'click': click, 'view': view}}, hour) AS l FROM traj WHERE scenario IN ('baseline', 'rich') GROUP BY ALL)),
    w AS (SELECT AVG(y) FILTER (scenario = 'baseline') AS b, AVG(y) FILTER (scenario = 'rich') AS m, stddev_pop(y) FILTER (scenario = 'baseline') AS sb, stddev_pop(y) FILTER (scenario = 'rich') AS sm FROM y)
    SELECT {r("m - b")} AS associational_difference, {r("b")} AS baseline_mean, {r("m")} AS modified_mean, {r("sb")} AS baseline_std, {r("sm")} AS modified_std FROM w""",
)
def assoc_difference(spark, folder):
    return rounded(sc.associational_difference(_trajectories(spark, folder), ["click", "view"], "baseline", "rich", ["id", "draw"]))


@query(
    "draw_interval",
    f"""WITH {_MANY}, m AS (SELECT id, hour, AVG(click) AS mean, stddev_pop(click) AS std FROM traj WHERE scenario = 'baseline' GROUP BY ALL)
    SELECT id, hour, {r("mean")} AS mean, {r("std")} AS std, {r("mean - 1.959963984540054 * std")} AS lower, {r("mean + 1.959963984540054 * std")} AS upper FROM m""",
)
def draw_interval(spark, folder):
    drawn = _draws(spark, folder, {"baseline": {}}, INTERVAL_DRAWS)
    m = sc.moments_of_draws(drawn, _series(spark, folder), ["id"], "donor", ["click"])
    lo, hi = gaussian_interval(F.col("mean"), F.col("std"))
    return rounded(m.select("id", "hour", "mean", "std", lo.alias("lower"), hi.alias("upper")))


@query(
    "ensemble_moments",
    f"""WITH {_BASE} SELECT id, hour, {r("AVG(view)")} AS mean, {r("stddev_pop(view)")} AS std FROM traj WHERE scenario IN ('baseline', 'rich') AND draw <= 3 GROUP BY id, hour""",
)
def ensemble_moments(spark, folder):
    t = cut_lineage(_trajectories(spark, folder))
    sources = {s: t.where(F.col("scenario") == s) for s in ("baseline", "rich")}
    return rounded(sc.ensemble_moments(sources, ["id"], ["view"], 3).drop("channel"))


@query(
    "map_override",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN 1.0 ELSE value END AS value, 'k' AS kind, CAST(2.0 AS DOUBLE) AS extra FROM events""",
)
def map_override_query(spark, folder):
    ev = table(spark, folder, "events")
    base = F.create_map(F.lit("value"), F.col("value"))
    over = F.when(F.col("event_type") == "click", F.create_map(F.lit("value"), F.lit(1.0), F.lit("extra"), F.lit(2.0))).otherwise(F.create_map(F.lit("extra"), F.lit(2.0)))
    m = ev.select("event_id", map_override(base, over).alias("m"))
    return m.select("event_id", F.col("m")["value"].alias("value"), F.lit("k").alias("kind"), F.col("m")["extra"].alias("extra"))
