"""Profile network: counts, scores, tables, sampling."""

from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.catalog.clinical import CODED_SQL, static_features
from tidemark.catalog.preparation import u_sql
from tidemark.catalog.registry import query, r, rounded, table
from tidemark.operators import bayes
from tidemark.operators.prep import quartile_edges
from tidemark.session import cut_lineage

NODES = ["o_orderpriority", "o_orderstatus", "c_mktsegment"]
PARENTS = {"o_orderpriority": [], "o_orderstatus": ["o_orderpriority"], "c_mktsegment": ["o_orderpriority", "o_orderstatus"]}
_DATA = "d AS (SELECT o_orderpriority, o_orderstatus, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey)"


def _profiles(spark, folder):
    j = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return bayes.distinct_profiles(j.select(*NODES), NODES)


def _key(ps) -> str:
    return " || '|' || ".join(f"'{p}=' || {p}" for p in ps) if ps else "''"


_FAMILIES = [(v, tuple(ps)) for v, ps in PARENTS.items()] + [("o_orderstatus", ("c_mktsegment",))]


def _counts_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS family, '{v}' AS node, {_key(ps)} AS parent_key, {v} AS state, COUNT(*) AS n FROM d GROUP BY ALL" for i, (v, ps) in enumerate(_FAMILIES)
    )


_LABS = vocab.LAB_COLUMNS
_TEXT = [c for c in vocab.PROFILE_FEATURES if c not in ("anchor_age", "los", *_LABS)]


def _quartile_sql(c: str) -> str:
    """The bin of a filled column; its edges are distinct quartiles, so with repeats there are fewer bins."""
    bins = " ".join(f"WHEN v_{c} <= e_{c}[{i + 1}] THEN 'Q{i}'" for i in range(1, 4))
    return f"CASE {bins} ELSE 'Q' || (len(e_{c}) - 1) END AS {c}"


@query(
    "profile_states",
    f"""WITH {CODED_SQL}, m AS (SELECT {", ".join(f"MEDIAN({c}) AS m_{c}" for c in _LABS)} FROM static),
    x AS (SELECT *, {", ".join(f"COALESCE({c}, m_{c}) AS v_{c}" for c in _LABS)} FROM static, m),
    e AS (SELECT {", ".join(f"list_sort(list_distinct(quantile_cont(v_{c}, [0, 0.25, 0.5, 0.75, 1]))) AS e_{c}" for c in _LABS)} FROM x)
    SELECT stay_id, CASE WHEN anchor_age < 45 THEN '18-45' WHEN anchor_age < 55 THEN '45-55' WHEN anchor_age < 65 THEN '55-65' WHEN anchor_age < 75 THEN '65-75' WHEN anchor_age < 85 THEN '75-85' ELSE '85+' END AS anchor_age,
      CASE WHEN los < 1 THEN '0-1d' WHEN los < 3 THEN '1-3d' WHEN los < 7 THEN '3-7d' WHEN los < 14 THEN '7-14d' ELSE '14+d' END AS los,
      {", ".join(_quartile_sql(c) for c in _LABS)}, {", ".join(f"COALESCE(CAST({c} AS VARCHAR), 'nan') AS {c}" for c in _TEXT)} FROM x, e""",
)
def profile_states(spark, folder):
    """All features of the profile network as states."""
    s = cut_lineage(static_features(spark, folder))
    return bayes.discretise(s, list(vocab.PROFILE_FEATURES), quartile_edges(s, list(_LABS)), keep=["stay_id"])


@query("family_counts", f"WITH {_DATA} {_counts_sql()}")
def family_counts(spark, folder):
    counts = bayes.family_counts(_profiles(spark, folder), _FAMILIES)
    text = bayes.parent_text({i: ps for i, (_, ps) in enumerate(_FAMILIES)}, "family")
    return counts.select("family", "node", text.alias("parent_key"), "state", "n")


_CARD = {"o_orderpriority": 5, "o_orderstatus": 3, "c_mktsegment": 5}


@query(
    "bic_scores",
    f"""WITH {_DATA}, c AS ({_counts_sql()}), l AS (SELECT family, SUM(n * ln(n)) AS a FROM c GROUP BY family),
    p AS (SELECT family, SUM(np * ln(np)) AS b FROM (SELECT family, parent_key, SUM(n) AS np FROM c GROUP BY ALL) GROUP BY family)
    SELECT CASE l.family {" ".join(f"WHEN {i} THEN '{v}<-{'+'.join(ps)}'" for i, (v, ps) in enumerate(_FAMILIES))} END AS family,
      {r("a - b - 0.5 * ln((SELECT COUNT(*) FROM d)) * CASE l.family " + " ".join(
          f"WHEN {i} THEN {(_CARD[v] - 1) * __import__('math').prod(_CARD[p] for p in ps)}" for i, (v, ps) in enumerate(_FAMILIES)) + " END", 4)} AS bic
    FROM l JOIN p ON l.family = p.family""",
)
def bic_scores(spark, folder):
    prof = cut_lineage(_profiles(spark, folder))
    states = bayes.states_of(prof, NODES)
    n = prof.agg(F.sum("weight")).first()[0]
    found = bayes.bic_scores(prof, _FAMILIES, states, n)
    rows = [(f"{v}<-{'+'.join(ps)}", s) for (v, ps), s in found.items()]
    return rounded(spark.createDataFrame(rows, "family string, bic double"), 4)


def _tables_sql() -> str:
    parts = []
    for v, ps in PARENTS.items():
        cols = [*ps, v]
        grid = " CROSS JOIN ".join(f"(SELECT DISTINCT {c} FROM d)" for c in cols)
        q = __import__("math").prod(_CARD[p] for p in ps)
        on = " AND ".join(f"g.{c} = d.{c}" for c in cols)
        parts.append(
            f"""SELECT '{v}' AS node, parent_key, state, n, (n + 10.0 / {q * _CARD[v]}) / (SUM(n) OVER (PARTITION BY parent_key) + 10.0 / {q}) AS prob FROM (
            SELECT {_key([f for f in ps]) if not ps else " || '|' || ".join(f"'{p}=' || g.{p}" for p in ps)} AS parent_key, g.{v} AS state, COUNT(d.{v}) AS n
            FROM (SELECT * FROM {grid}) g LEFT JOIN d ON {on} GROUP BY ALL)"""
        )
    return "t0 AS (" + " UNION ALL ".join(parts) + "), t AS (SELECT *, SUM(prob) OVER (PARTITION BY node, parent_key ORDER BY state ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_hi FROM t0)"


def _network(spark, folder):
    prof = cut_lineage(_profiles(spark, folder))
    states = bayes.states_of(prof, NODES)
    n = prof.agg(F.sum("weight")).first()[0]
    tables = cut_lineage(bayes.probability_tables(prof, PARENTS, states, n))
    return bayes.ProfileNetwork(NODES, PARENTS, states, tables), n


@query(
    "cpd_bdeu",
    f"WITH {_DATA}, {_tables_sql()} SELECT node, parent_key, state, n, {r('prob')} AS prob, {r('cum_hi - prob')} AS cum_lo, {r('cum_hi')} AS cum_hi FROM t",
)
def cpd_bdeu(spark, folder):
    return rounded(_network(spark, folder)[0].described())


@query(
    "edge_probabilities",
    f"WITH {_DATA}, {_tables_sql()} SELECT parent_key, 'c_mktsegment=' || state AS outcome, state, {r('prob')} AS prob FROM t WHERE node = 'c_mktsegment'",
)
def edge_probabilities(spark, folder):
    return rounded(_network(spark, folder)[0].analyse_edges("c_mktsegment", ["o_orderstatus"])["table"])


def _sample_sql() -> str:
    steps = ["s0 AS (SELECT r AS row_id, CAST(ds AS INT) AS dataset_id FROM range((SELECT COUNT(*) FROM d)) a(r), range(2) b(ds))"]
    for i, (v, ps) in enumerate(PARENTS.items()):
        u = u_sql("42 + dataset_id", "row_id", f"'{v}'")
        steps.append(
            f"""s{i + 1} AS (SELECT s.*, t.state AS {v} FROM (SELECT *, {_key(ps)} AS pk, {u} AS u FROM s{i}) s
            JOIN t ON t.node = '{v}' AND t.parent_key = s.pk AND s.u < t.cum_hi AND s.u >= t.cum_hi - t.prob)"""
        )
        steps[-1] = steps[-1].replace("SELECT s.*,", "SELECT s.* EXCLUDE (pk, u),")
    return ", ".join(steps)


@query(
    "forward_sample",
    f"WITH {_DATA}, {_tables_sql()}, {_sample_sql()} SELECT row_id, dataset_id, {', '.join(NODES)} FROM s3",
)
def forward_sample(spark, folder):
    net, n = _network(spark, folder)
    return net.sample_states(n, 42, 2)


_RANGES = {"1-URGENT": (0, 10), "2-HIGH": (10, 20), "3-MEDIUM": (20, 40), "4-NOT SPECIFIED": (40, 80), "5-LOW": (80, 160)}


def _case(i: int) -> str:
    return "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN {v[i]}.0" for k, v in _RANGES.items()) + " END"


@query(
    "inverse_bins",
    f"""WITH {_DATA}, {_tables_sql()}, {_sample_sql()} SELECT row_id, dataset_id, o_orderstatus,
    {r(f"{_case(0)} + ({_case(1)} - {_case(0)}) * {u_sql('0', 'dataset_id', 'row_id', chr(39) + 'o_orderpriority' + chr(39), chr(39) + 'value' + chr(39))}")} AS o_orderpriority FROM s3""",
)
def inverse_bins(spark, folder):
    net, n = _network(spark, folder)
    net.fixed_bins, net.inverse_ranges = {"o_orderpriority": None}, {"o_orderpriority": _RANGES}
    return rounded(net.sample(n, 42, 2).select("row_id", "dataset_id", "o_orderstatus", "o_orderpriority"))


_LONE = ["o_orderpriority", "c_mktsegment"]


@query(
    "isolated_marginals",
    f"WITH {_DATA} "
    + " UNION ALL ".join(
        f"SELECT '{v}' AS node, {v} AS state, COUNT(*) AS n, {r('COUNT(*) / (SELECT CAST(COUNT(*) AS DOUBLE) FROM d)')} AS prob FROM d GROUP BY {v}" for v in _LONE
    ),
)
def isolated_marginals(spark, folder):
    """Nodes without any edge keep their plain shares."""
    prof = cut_lineage(_profiles(spark, folder))
    tables = bayes.probability_tables(prof, {v: [] for v in _LONE}, bayes.states_of(prof, _LONE), prof.agg(F.sum("weight")).first()[0])
    return rounded(tables.select("node", "state", "n", "prob"))


@query(
    "static_series_pairs",
    "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')",
)
def static_series_pairs(spark, folder):
    """Profiles that have a series, each once however many rows the series has."""
    series = table(spark, folder, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"))
    return bayes.pair_static_with_series(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), series, "c_custkey")


@query("network_edges")
def network_edges(spark, folder):
    """Structure learned on the static features: one row per edge."""
    s = cut_lineage(static_features(spark, folder).select(*vocab.PROFILE_FEATURES))
    return spark.createDataFrame(bayes.fit_network(s).edge_list(), "parent string, child string")


@query("network_sample")
def network_sample(spark, folder):
    """As many synthetic profiles as there are real ones, with their series paired."""
    s = cut_lineage(static_features(spark, folder).select("stay_id", *vocab.PROFILE_FEATURES))
    s = bayes.pair_static_with_series(s, table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("stay_id")))
    return bayes.fit_network(s).sample(s.count(), 42, 1)
