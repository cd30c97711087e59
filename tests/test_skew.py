"""Blocked and hot-group paths give what the plain forms give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import skew, timeseries, twin
from tidemark.operators.neighbors import nearest_distances


@pytest.fixture(scope="module")
def hot(spark):
    """One group holds well over a third of the rows; many equal values."""
    rng = np.random.default_rng(3)
    n = 3000
    g = np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abcde"), n))
    v = np.where(rng.random(n) < 0.4, 7.0, np.round(rng.normal(0, 5, n), 2))
    pdf = pd.DataFrame({"id": range(n), "g": g, "v": v, "w": rng.random(n)})
    pdf.loc[rng.random(n) < 0.1, "w"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("w", F.when(~F.isnan("w"), F.col("w")))
    return pdf, df.repartition(6)


def _forced(df, cols, probs, group=()):
    return skew.quantiles(df, cols, probs, group, n_blocks=9)


@pytest.mark.parametrize("group", [[], ["g"]])
def test_quantiles_both_ways(hot, group):
    pdf, df = hot
    probs = [0.0, 0.05, 0.5, 0.77, 1.0]
    for q in (_forced(df, ["v", "w"], probs, group), skew.quantiles(df, ["v", "w"], probs, group)):
        for r in q.collect():
            part = pdf[pdf.g == r["g"]] if group else pdf
            want = part[r["variable"]].quantile(probs).tolist()
            assert r["n"] == part[r["variable"]].notna().sum()
            assert [r[f"q{i}"] for i in range(5)] == pytest.approx(want, abs=1e-9)


def test_running_sums_both_ways(hot):
    pdf, df = hot
    edges = skew.fit_blocks(df, ["v"], 9)
    a = skew.running_sums(skew.value_sums(df, ["g"], ["v"], edges), ["g", "variable"], ["cnt"], True)
    b = skew.running_sums(skew.value_sums(df, ["g"], ["v"], None), ["g", "variable"], ["cnt"], False)
    cols = ["g", "variable", "value", "cnt", "cnt_before", "cnt_total"]
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_hash_rank_is_a_permutation(hot):
    pdf, df = hot
    out = skew.hash_rank(df, ["id"], 1, ["g"], n_blocks=7).toPandas()
    for g, part in out.groupby("g"):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))
        assert (part["stratum_rows"] == len(part)).all()
    again = skew.hash_rank(df.repartition(3), ["id"], 1, ["g"], n_blocks=2).toPandas()
    assert dict(zip(out["id"], out["rank"])) == dict(zip(again["id"], again["rank"]))


def test_hot_group_medians(hot):
    pdf, df = hot
    rows = df.withColumn("item", F.when(F.col("id") % 3 == 0, "x").otherwise("y"))
    items = {"x": "mx", "y": "my"}
    plain = timeseries.hourly_medians(rows, ["g"], "item", items, "v")
    split = timeseries.hourly_medians(rows, ["g"], "item", items, "v", hot_rows=1000, hot_rate=1.0)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, split.collect()))
    assert skew.hot_groups(rows, ["g"], 1000, 1.0).collect()[0]["g"] == "hot"
    wide = {"v": "mv", "w": "mw"}
    a = timeseries.hourly_column_medians(df, ["g"], wide)
    b = timeseries.hourly_column_medians(df, ["g"], wide, hot_rows=1000, hot_rate=1.0)
    for x, y in zip(sorted(map(tuple, a.collect())), sorted(map(tuple, b.collect()))):
        assert x[0] == y[0] and x[1:] == pytest.approx(y[1:])


@pytest.mark.parametrize("block", [1, 3, 100])
def test_forward_fill_across_blocks(spark, block):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame([(k, h, None if rng.random() < 0.6 else float(h)) for k in (1, 2) for h in range(40)], columns=["k", "h", "x"])
    want = pdf.assign(x=pdf.groupby("k")["x"].ffill())
    got = timeseries.forward_fill(spark.createDataFrame(pdf.astype({"x": "float64"}).replace({np.nan: None}), "k long, h long, x double"), ["k"], "h", ["x"], block)
    got = got.toPandas().sort_values(["k", "h"])
    assert np.array_equal(got["x"].to_numpy(float), want["x"].to_numpy(float), equal_nan=True)


def test_moving_average_equals_fold(spark):
    rng = np.random.default_rng(5)
    rows = []
    for e in range(6):
        for i in range(int(rng.integers(1, 60))):
            err = {} if (rng.random() < 0.2 or (e == 0 and i == 0)) else {"a": float(rng.random()), "b": float(rng.random())}
            rows.append((e, int(rng.integers(0, 50)), i, err))
    want = {}
    for e in range(6):
        ema = 0.0
        for n, (_, _, _, err) in enumerate(sorted((r for r in rows if r[0] == e), key=lambda r: (r[1], r[2]))):
            if err:
                m = sum(err.values()) / len(err)
                ema = m if n == 0 else 0.3 * m + 0.7 * ema
        want[e] = ema
    df = spark.createDataFrame(rows, "entity_id int, s int, i int, error map<string,double>").withColumn("ts", F.timestamp_seconds("s"))
    for small in (True, False):
        if not small:
            orig = twin.fit_blocks
            twin.fit_blocks = lambda d, c: orig(d, c, 5)
        try:
            got = {r["entity_id"]: r["recent_drift"] for r in twin.ema_drift(df, ties=["i"]).collect()}
        finally:
            if not small:
                twin.fit_blocks = orig
        assert got == pytest.approx(want)


def test_moving_average_closed_form(spark):
    df = spark.createDataFrame([(1, i, {"x": float(e)}) for i, e in enumerate([1, 2, 3])], "entity_id int, s int, error map<string,double>")
    got = twin.ema_drift(df.withColumn("ts", F.timestamp_seconds("s"))).first()
    assert got["recent_drift"] == pytest.approx(1.81)


@pytest.mark.parametrize("k, block_rows, chain", [(1, 4096, 64), (1, 4, 64), (4, 4, 2), (4, 2, 1), (3, 1, 1)])
def test_neighbours_against_brute_force(spark, k, block_rows, chain):
    rng = np.random.default_rng(1)
    refs = np.vstack([rng.normal(0, 1, (150, 3)), rng.normal(8, 0.1, (150, 3)), np.tile([[8.0, 8.0, 8.0]], (120, 1))])
    qs = np.vstack([rng.normal(0, 2, (90, 3)), refs[200:230], refs[-5:]])
    is_ref = np.r_[np.zeros(90, bool), np.ones(35, bool)]
    R = spark.createDataFrame([(list(map(float, r)),) for r in refs], "vec array<double>")
    Q = spark.createDataFrame([(i, list(map(float, q)), bool(s)) for i, (q, s) in enumerate(zip(qs, is_ref))], "id long, vec array<double>, own boolean")
    out = nearest_distances(Q, R, "id", k=k, skip_self="own", block_rows=block_rows, chain=chain)
    got = {r["id"]: r["distances"] for r in out.collect()}
    assert len(got) == len(qs)
    for i, q in enumerate(qs):
        d = np.sort(np.sqrt(((refs - q) ** 2).sum(1)))
        want = d[1 : k + 1] if is_ref[i] else d[:k]
        assert got[i] == pytest.approx(list(want), abs=1e-9)


def test_neighbours_of_few_and_no_rows(spark):
    R = spark.createDataFrame([([0.0, 0.0],), ([0.0, 0.0],), ([3.0, 4.0],)], "vec array<double>")
    Q = spark.createDataFrame([("a", [0.0, 0.0]), (None, [3.0, 4.0])], "id string, vec array<double>")
    got = {r["id"]: r["distances"] for r in nearest_distances(Q, R, "id", k=5).collect()}
    assert got == {"a": [0.0, 0.0, 5.0], None: [0.0, 5.0, 5.0]}
    assert nearest_distances(Q.where("false"), R, "id").count() == 0
    with pytest.raises(ValueError, match="no reference rows"):
        nearest_distances(Q, R.where("false"), "id")


def test_far_blocks_are_not_compared(spark):
    """On clustered vectors the descent leaves few of all pairs of blocks."""
    from tidemark.operators import neighbors as nb

    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(0, 50, (40, 4)), 30, axis=0) + rng.normal(0, 0.1, (1200, 4))
    df = spark.createDataFrame([(i, list(map(float, v)), False, 1) for i, v in enumerate(x)], "qid long, vec array<double>, skip boolean, mult long")
    n, mean, sd = nb._moments(df)
    q, r = nb._blocks(df, n, 32, mean, sd, "skip", "bool", "qid"), nb._blocks(df, n, 8, mean, sd, "mult", "int64")
    pairs = nb._surviving(nb._tree(q), nb._tree(r), 1).count()
    assert pairs < 0.25 * q.count() * r.count()


def test_boxes_rule_out_what_balls_do_not(spark):
    """Flags beside wide columns: a ball around equal flags reaches over the others, a box does not."""
    from tidemark.operators import neighbors as nb

    rng = np.random.default_rng(5)
    x = np.c_[3.0 * rng.integers(0, 2, (1600, 4)), rng.uniform(0, 4, (1600, 2))]
    df = spark.createDataFrame([(i, list(map(float, v)), False, 1) for i, v in enumerate(x)], "qid long, vec array<double>, skip boolean, mult long")
    n, mean, sd = nb._moments(df)
    q, r = nb._blocks(df, n, 32, mean, sd, "skip", "bool", "qid"), nb._blocks(df, n, 32, mean, sd, "mult", "int64")
    pairs = nb._surviving(nb._tree(q), nb._tree(r), 1).count()
    assert pairs < 0.25 * q.count() * r.count()


def test_near_ties_far_from_zero_are_told_apart():
    """Single precision alone does not tell these distances apart."""
    from tidemark.operators import neighbors as nb

    rng = np.random.default_rng(6)
    r = np.repeat(rng.normal(1e5, 1, (60, 5)), 8, axis=0) + rng.normal(0, 1e-6, (480, 5))
    q = r[rng.choice(480, 300)] + rng.normal(0, 1e-6, (300, 5))
    q[:5] = r[:5]
    refs = [nb._Refs(pd.Series({"data": p.tobytes(), "extra": np.ones(len(p), "int64").tobytes(), "centre": p.mean(0), "radius": np.sqrt(((p - p.mean(0)) ** 2).sum(1).max())}), 5) for p in np.split(r, 6)]
    lo, hi = (np.stack([f(p, axis=0) for p in np.split(r, 6)]) for f in (np.min, np.max))
    best = np.full((300, 1), np.inf)
    nb._visit(q, best, best[:, -1].copy(), np.zeros(300, bool), refs, lo, hi)
    assert best[:, 0].tolist() == np.sqrt(((q[:, None] - r[None]) ** 2).sum(2)).min(1).tolist()


def test_blocks_follow_the_counted_rows(hot):
    pdf, df = hot
    assert skew.fit_blocks(df, ["v"]) is None
    assert len(skew.fit_blocks(df, ["id"], block_rows=30)["id"]) > skew.FIRST_BLOCKS


def test_weighted_quantiles(hot):
    pdf, df = hot
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("k"))
    for n_blocks in (None, 7):
        got = skew.quantiles(counts, ["v"], [0.5], ["g"], n_blocks, weight="k")
        assert {r["g"]: r["q0"] for r in got.collect()} == pytest.approx(pdf.groupby("g")["v"].median().to_dict())


def test_cuts_agree_with_ranks(hot, monkeypatch):
    """The radix selection takes the rows that the full ranking takes, also with few slices, NULL strata and empty shares."""
    pdf, df = hot
    monkeypatch.setattr(skew, "SLICES", 4)
    ranked = {r["id"]: (r["rank"], r["stratum_rows"]) for r in skew.hash_rank(df, ["id"], 5, ["g"]).collect()}
    cuts = skew.hash_cuts(df, ["id"], 5, ["g"], lambda rows: [F.floor(rows * 0.3), F.lit(0), rows])
    out = skew.null_safe_join(df, cuts, ["g"], "left").select(
        "id", *[skew.upto_cut(f"cut{i}", ["id"], 5).alias(f"t{i}") for i in range(3)]
    ).collect()
    assert len(out) == len(ranked)
    for r in out:
        rank, rows = ranked[r["id"]]
        assert r["t0"] == (rank <= int(rows * 0.3)) and not r["t1"] and r["t2"]


def test_samples_and_splits_of_few_rows(spark):
    from tidemark.operators.prep import random_sample, stratified_split

    df = spark.createDataFrame([(i, "a" if i < 7 else None) for i in range(10)], "id long, s string")
    assert random_sample(df, ["id"], 4).count() == 4
    assert random_sample(df, ["id"], 99).count() == 10
    assert random_sample(df.where("false"), ["id"], 3).count() == 0
    got = stratified_split(df, ["id"], "s", 0.3, 0.3).groupBy("s", "split").count().collect()
    assert {(r["s"], r["split"]): r["count"] for r in got} == {("a", "test"): 2, ("a", "val"): 2, ("a", "train"): 3, (None, "test"): 1, (None, "val"): 1, (None, "train"): 1}


def test_drift_takes_records_without_a_time_last(spark, monkeypatch):
    """As SQL orders them, whether times are cut into blocks or not."""
    rows = [(1, 1_700_000_000 + 60 * i if i % 4 else None, i, float(i * i % 13)) for i in range(20)]
    df = spark.createDataFrame(rows, "entity_id int, s long, i int, e double").selectExpr(
        "entity_id", "timestamp_seconds(s) AS ts", "i", "map('c', e) AS error"
    )
    want = None
    for _, _, _, e in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2])):
        want = e if want is None else 0.3 * e + 0.7 * want
    assert twin.ema_drift(df, ties=["i"]).first()["recent_drift"] == pytest.approx(want)
    monkeypatch.setattr(twin, "fit_blocks", lambda d, cols: skew.fit_blocks(d, cols, 4))
    assert twin.ema_drift(df, ties=["i"]).first()["recent_drift"] == pytest.approx(want)
