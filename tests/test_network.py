"""Profile network: structure, tables, sampling."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bayes, scenario


@pytest.fixture(scope="module")
def profiles(spark):
    rng = np.random.default_rng(0)
    n = 600
    a = rng.choice(["x", "y"], n)
    b = np.where(rng.random(n) < 0.9, a, rng.choice(["x", "y"], n))
    c = rng.choice(["p", "q", "r"], n)
    rare = (rng.random(n) < 0.05).astype(int)
    pdf = pd.DataFrame({"a": a, "b": b, "c": c, "rare": rare, "anchor_age": rng.integers(18, 95, n), "lab_x": rng.normal(10, 2, n)})
    return pdf, spark.createDataFrame(pdf)


def test_structure_and_sampling(profiles):
    pdf, df = profiles
    net = bayes.fit_network(df, ["a", "b", "c", "rare", "anchor_age", "lab_x"], ["lab_x"])
    pairs = {frozenset(e) for e in net.edge_list()}
    assert frozenset(("a", "b")) in pairs
    assert all(len(p) <= 3 for p in net.parents.values())
    out = net.sample(800, 42)
    assert out.count() == 800
    row = out.agg(F.avg("rare"), F.min("anchor_age"), F.max("anchor_age"), F.min("lab_x"), F.max("lab_x")).first()
    assert abs(row[0] - pdf["rare"].mean()) < 0.10
    assert 18 <= row[1] and row[2] <= 100
    assert pdf["lab_x"].min() <= row[3] and row[4] <= pdf["lab_x"].max()
    assert dict(out.dtypes)["rare"] == "int"
    again = net.sample(800, 42)
    assert out.exceptAll(again).count() == 0
    two = net.sample(50, 42, datasets=2)
    assert two.where("dataset_id = 1").drop("dataset_id").exceptAll(two.where("dataset_id = 0").drop("dataset_id")).count() > 0


def test_tables_sum_to_one(profiles):
    _, df = profiles
    net = bayes.fit_network(df, ["a", "b", "c"], [])
    for r in net.tables.groupBy("node", "parent_states").agg(F.sum("prob").alias("s"), F.max("cum_hi").alias("h")).collect():
        assert r["s"] == pytest.approx(1.0) and r["h"] == pytest.approx(1.0)
    iso = [v for v in net.features if not net.parents[v] and not any(v in p for p in net.parents.values())]
    for v in iso:  # isolated nodes keep their plain shares
        want = df.groupBy(v).count().toPandas().set_index(v)["count"] / 600
        got = net.table(v).toPandas().set_index("state")["prob"]
        assert got.to_dict() == pytest.approx(want.to_dict())


def test_bic_by_hand(profiles):
    pdf, df = profiles
    p = bayes.distinct_profiles(df.select("a", "b"), ["a", "b"])
    states = bayes.states_of(p, ["a", "b"])
    got = bayes.bic_scores(p, [("b", ("a",)), ("b", ())], states, 600)
    ct = pd.crosstab(pdf["a"], pdf["b"])
    ll = sum(ct.loc[i, j] * math.log(ct.loc[i, j] / ct.loc[i].sum()) for i in ct.index for j in ct.columns)
    assert got["b", ("a",)] == pytest.approx(ll - 0.5 * math.log(600) * 2)
    one = ct.sum()
    assert got["b", ()] == pytest.approx(sum(v * math.log(v / 600) for v in one) - 0.5 * math.log(600))


def test_search_reaches_a_local_optimum(profiles):
    _, df = profiles
    feats = ["a", "b", "c"]
    p = bayes.distinct_profiles(df.select(*feats), feats)
    states = bayes.states_of(p, feats)
    found = bayes.learn_structure(p, feats, states, 600)
    score = lambda ps: sum(bayes.bic_scores(p, [(v, tuple(sorted(ps[v])))], states, 600)[v, tuple(sorted(ps[v]))] for v in feats)
    base = score(found)
    for u in feats:
        for v in feats:
            if u != v and u not in found[v] and not bayes._reaches(found, v, u):
                assert score({**found, v: found[v] | {u}}) <= base + 1e-4
            if u in found[v]:
                assert score({**found, v: found[v] - {u}}) <= base + 1e-4


def test_no_common_key_is_an_error(spark):
    a, b = spark.createDataFrame([(1,)], "stay_id int"), spark.createDataFrame([(2,)], "stay_id int")
    with pytest.raises(ValueError):
        bayes.pair_static_with_series(a, b)


def test_very_many_states_are_sampled(spark):
    """20,000 states of a node, a rare and a hot parent state: shares follow the table, nothing is refused."""
    df = spark.range(40_000).select(
        F.when(F.col("id") % 100 == 0, "rare").otherwise("hot").alias("a"), F.concat(F.lit("s"), F.col("id") % 20_000).alias("b")
    )
    profiles = bayes.distinct_profiles(df, ["a", "b"])
    states = bayes.states_of(profiles, ["a", "b"])
    assert states.counts == {"a": 2, "b": 20_000}
    parents = {"a": [], "b": ["a"]}
    net = bayes.ProfileNetwork(["a", "b"], parents, states, bayes.probability_tables(profiles, parents, states, 40_000, full=False))
    got = net.sample_states(5_000, 3)
    row = got.agg(F.count("b").alias("n"), F.countDistinct("b").alias("d"), F.avg((F.col("a") == "hot").cast("int")).alias("hot")).first()
    assert row["n"] == 5_000 and row["d"] > 3_500 and abs(row["hot"] - 0.99) < 0.01


def test_marks_in_states_and_unseen_combinations(spark):
    """States with | and = stay apart; a parent combination without rows has equal shares, listed or not."""
    rows = [("x|b=y", "z", "p")] * 6 + [("x", "b=y|z", "q")] * 6 + [("x", "z", "p")] * 3 + [("x", "z", "q")] * 1
    df = spark.createDataFrame(rows, "a string, b string, c string")
    profiles = bayes.distinct_profiles(df, ["a", "b", "c"])
    states = bayes.states_of(profiles, ["a", "b", "c"])
    parents = {"a": [], "b": [], "c": ["a", "b"]}
    full, seen = (bayes.ProfileNetwork(["a", "b", "c"], parents, states, bayes.probability_tables(profiles, parents, states, 16, full=f)) for f in (True, False))
    table = {(tuple(r["parent_states"]), r["state"]): r["prob"] for r in full.table("c").collect()}
    assert len(table) == 8 and table[("x|b=y", "z"), "p"] == pytest.approx((6 + 10 / 8) / (6 + 10 / 4))
    assert table[("x|b=y", "b=y|z"), "p"] == pytest.approx(0.5)
    assert seen.table("c").count() == 6
    one, other = (net.sample_states(400, 7).collect() for net in (full, seen))
    assert {(r["row_id"], r["a"], r["b"], r["c"]) for r in one} == {(r["row_id"], r["a"], r["b"], r["c"]) for r in other}
    assert any(r["a"] == "x|b=y" and r["b"] == "b=y|z" for r in one)


def test_scenario_backs_off(spark):
    donors = spark.createDataFrame([(1, "x", "lo"), (2, "x", "hi"), (3, "y", "hi")], "donor int, a string, b string")
    profiles = spark.createDataFrame([(10, "x", "lo"), (11, "y", "lo"), (12, "z", "lo")], "id int, a string, b string")
    d = scenario.draw_donors(profiles, donors, ["id"], "donor", ["a", "b"], 8).toPandas()
    assert d.groupby("id").size().to_dict() == {10: 8, 11: 8, 12: 8}
    assert set(d[d.id == 10].donor) == {1} and set(d[d.id == 11].donor) == {3}
    assert d[d.id == 12].matched_on.unique().tolist() == [0]


def test_empty_override_is_baseline(spark):
    p = spark.createDataFrame([(1, "x", 5.0)], "id int, a string, v double")
    out = {r["scenario"]: r for r in scenario.expand_scenarios(p, {"base": {}, "up": {"v": 9.0}, "none": {"a": None}}).collect()}
    assert out["base"]["v"] == 5.0 and out["up"]["v"] == 9.0 and out["up"]["a"] == "x" and out["none"]["a"] is None


def test_draws_come_from_bounded_parts_of_the_profiles(spark, monkeypatch):
    """The profiles are dealt to tasks by their counted number, copies of a profile draw once, and nulls match as a value."""
    rows = [(i, "xy"[i % 2] if i % 5 else None, "pqr"[i % 3]) for i in range(40)]
    profiles = spark.createDataFrame([*rows, rows[3], (40, "never", "p")], "id int, a string, b string")
    donors = spark.createDataFrame([(i, "xy"[i % 2] if i % 4 else None, "pq"[i % 2]) for i in range(100, 130)], "donor int, a string, b string")
    whole = scenario.draw_donors(profiles, donors, ["id"], "donor", ["a", "b"], 4)
    monkeypatch.setattr(scenario, "PROFILE_ROWS", 8)
    parts = scenario.draw_donors(profiles, donors, ["id"], "donor", ["a", "b"], 4)
    plan = parts._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan or "Repartition" in plan
    found = sorted(map(tuple, parts.collect()))
    assert found == sorted(map(tuple, whole.collect()))
    assert len(found) == 41 * 4
    known = {(None if a is None else a, b) for _, a, b in map(tuple, donors.collect())}
    have = {a for a, _ in known}
    of = {r[0]: r[1:] for r in map(tuple, profiles.collect())}
    assert all(m == (2 if of[i] in known else 1 if of[i][0] in have else 0) for i, _, m, _ in found)


def test_moments_of_draws_are_those_of_their_trajectories(spark):
    """Draws take packed series along: no step is shuffled by (entity, hour)."""
    draws = spark.createDataFrame([(i % 7, d, (i * 3 + d) % 5) for i in range(7) for d in range(6)], "id int, draw int, donor int")
    series = spark.createDataFrame([(k, h, float(k * h) if (k + h) % 4 else None) for k in range(4) for h in range(k + 3)], "donor int, hour int, x double")
    got = scenario.moments_of_draws(draws, series, ["id"], "donor", ["x"])
    want = scenario.repeated_draw_moments(scenario.conditional_trajectories(draws, series, "donor"), ["id"], ["x"])
    rows = lambda d: sorted((r["id"], r["hour"], r["channel"], r["mean"] is None, round(r["mean"] or 0, 9), round(r["std"] or 0, 9)) for r in d.collect())
    assert rows(got) == rows(want) and rows(got)
    assert "hashpartitioning(id" in got._jdf.queryExecution().executedPlan().toString()
    assert "hour" not in " ".join(x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)


def test_scores_from_numbered_states_are_those_of_the_states(spark, monkeypatch):
    """Numbers in arrays, numbers by batch and plain states count the same; a missing state counts as one of its own."""
    rows = [("xyz"[i % 3], "pq"[i * 7 % 2] if i % 11 else None, f"s{i * i % 5}", f"t{i % 4}") for i in range(200)]
    names = ["a", "b", "c", "d"]
    profiles = bayes.distinct_profiles(spark.createDataFrame(rows, "a string, b string, c string, d string"), names)
    states = bayes.states_of(profiles, names)
    families = [("a", ()), ("a", ("b",)), ("b", ("a",)), ("c", ("a", "b")), ("d", ("a", "b", "c"))]
    coded = bayes.coded_profiles(profiles, names, states)
    assert coded.columns == ["x", "weight"] and coded.agg(F.sum("weight")).first()[0] == 200
    arrays = bayes.bic_scores(profiles, families, states, 200, coded)
    monkeypatch.setattr(bayes, "DENSE_CELLS", 0)
    batches = bayes.bic_scores(profiles, families, states, 200)
    monkeypatch.setattr(bayes, "MOST_CODES", 0)
    plain = bayes.bic_scores(profiles, families, states, 200)
    assert arrays == pytest.approx(plain) and batches == pytest.approx(plain)
