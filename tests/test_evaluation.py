"""Closed-form metric fixtures and metamorphic checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import distributions as dist
from tidemark.operators import fidelity, plausibility, privacy, stattests, temporal, utility
from tidemark.plans import evaluation


def frame(spark, seed, n, shift=0.0, flag=False):
    rng = np.random.default_rng(seed)
    rows = [(i, float(a + shift), float(b + shift), int(f)) for i, (a, b, f) in enumerate(zip(rng.normal(size=n), rng.normal(size=n), rng.random(n) < 0.3))]
    return spark.createDataFrame(rows, "id long, f1 double, f2 double, flag int")


def test_distribution_tails():
    assert dist.t_quantile(0.975, 36) == pytest.approx(2.028094, abs=1e-6)
    assert dist.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert dist.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert dist.chi2_sf(9.487729, 4) == pytest.approx(0.05, abs=1e-6)
    assert 2 * dist.t_sf(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.kolmogorov_sf(1.358099) == pytest.approx(0.05, abs=1e-4)
    assert dist.kolmogorov_sf(0.29) == pytest.approx(1.0, abs=1e-4)


def test_exact_ks_small_samples():
    # two samples of two, fully apart: 2 of the 6 orderings reach D = 1
    assert dist.ks_two_sample_p(1.0, 2, 2, "exact") == pytest.approx(2 / 6)
    assert dist.ks_two_sample_p(0.5, 2, 2, "exact") == pytest.approx(1.0)
    assert dist.ks_two_sample_p(1.0, 3, 4, "exact") == pytest.approx(2 / 35)


def test_ks_self_and_shifted(spark):
    a = frame(spark, 0, 100)
    same = stattests.ks_tests(a, a, ["f1"]).first()
    assert same["ks_stat"] == 0 and same["pvalue"] > 0.9
    moved = stattests.ks_tests(a, frame(spark, 1, 100, 5.0), ["f1"]).first()
    assert moved["pvalue"] < 0.05


def test_ks_short_window_is_noted(spark):
    a, b = frame(spark, 0, 1), frame(spark, 1, 50)
    r = stattests.distribution_shift(a, b, ["f1"]).first()
    assert r["ks_stat"] is None and r["note"] == "insufficient data" and not r["any_significant"]


def test_frobenius(spark):
    a = frame(spark, 0, 200)
    x = a.withColumn("f2", F.col("f1") + 0.1 * F.col("f2"))
    assert fidelity.correlation_distance(x, x, ["f1", "f2"]).first()[0] == 0
    y = frame(spark, 9, 200).withColumn("f2", F.col("f1") + 0.1 * F.col("f2"))
    assert fidelity.correlation_distance(x, y, ["f1", "f2"]).first()[0] < 0.5


def test_discriminator_on_itself(spark):
    a = frame(spark, 0, 200)
    b = a.withColumn("id", F.col("id") + 1000)
    assert 0.3 <= fidelity.discriminator(a, b, ["f1", "f2"], ["id"])["auc"] <= 0.7


def test_category_abundance(spark):
    mk = lambda *n: spark.createDataFrame([(c,) for c, k in zip("abc", n) for _ in range(k)], "c string")
    assert fidelity.category_abundance(mk(70, 20, 10), mk(65, 25, 10), "c").first()[0] == pytest.approx(0.10)
    assert fidelity.category_abundance(mk(1, 0, 0), mk(0, 1, 0), "c").first()[0] == pytest.approx(2.0)


def test_rules(spark):
    cols = "anchor_age double, gcs_total int, los double"
    good = spark.createDataFrame([(65.0, 12, 2.0), (70.0, 8, 5.0), (55.0, 15, 1.0)], cols)
    bad = spark.createDataFrame([(5.0, 2, -1.0), (200.0, 8, 5.0), (65.0, 16, 1.0)], cols)
    total = lambda d, **k: plausibility.check_rules(d, **k).where("rule = 'total'").first()
    assert total(good)["violations"] == 0
    assert total(bad)["violations"] == 5 and total(bad)["violation_rate"] == pytest.approx(5 / 21)
    norm = spark.createDataFrame([(0.0,), (0.5,), (-0.5,)], "anchor_age double")
    assert total(norm, norm_params={"anchor_age": {"min": 18, "max": 100}})["violations"] == 0
    assert total(spark.createDataFrame([(None,)], "los double"))["violations"] == 1
    assert total(good.limit(0))["violation_rate"] == 0


def test_rubin(spark):
    rows = [("m", "a", v) for v in (5.0, 5.2, 4.8, 5.1, 5.05)] + [("m", "b", v) for v in (5.1, 5.3, 5.0)] + [("m", "c", float("nan"))] + [("m", "d", 2.0)]
    out = {r["metric"]: r for r in stattests.rubin_pool(spark.createDataFrame(rows, "model string, metric string, value double")).collect()}
    a = out["a"]
    assert a["pooled_estimate"] == pytest.approx(5.03) and a["between_variance"] > 0 and a["m"] == 5
    assert a["ci_lower"] < 5.03 < a["ci_upper"]
    assert out["b"]["pooled_estimate"] == pytest.approx(5.1333, abs=1e-3)
    assert out["c"]["pooled_estimate"] is None and out["c"]["ci_lower"] is None
    assert out["d"]["ci_lower"] == out["d"]["ci_upper"] == 2.0


def test_tstr_ranges_and_single_class(spark):
    train, synth, test = frame(spark, 0, 200), frame(spark, 1, 200), frame(spark, 2, 50)
    out = utility.tstr(train, synth, test, "flag", ["f1", "f2"], trees=5)
    assert all(0 <= out[k] <= 1 for k in out)
    one = utility.tstr(train, synth, test.withColumn("flag", F.lit(0)), "flag", ["f1", "f2"], trees=5)
    assert one["trtr_auc"] == one["tstr_auc"] == 0.5
    with pytest.raises(ValueError):
        utility.tstr(train, synth.withColumn("flag", F.lit(0)), test, "flag", ["f1", "f2"], trees=5)
    assert evaluation.utility_metrics(train, synth.drop("flag"), [3], test, "flag", ["id"]) == {3: evaluation.UNDEFINED_UTILITY}


def test_privacy(spark):
    real, synth = frame(spark, 0, 100), frame(spark, 1, 80, 10.0)
    m = privacy.membership_inference(real, synth, ["f1", "f2"], "id", "id").first()
    assert m["mia_f1"] == 1.0 and m["mean_nn_distance"] > 0
    d = privacy.dcr_summary(privacy.closest_record(real, synth, ["f1", "f2"], "id", "id")).first()
    assert d["mean_dcr"] > 0 and d["min_dcr"] <= d["p5_dcr"] <= d["median_dcr"]
    assert privacy.attribute_inference(real, synth, "absent", ["f1"]) == 0.0
    assert 0 <= privacy.attribute_inference(real, synth, "flag", ["f1", "f2"], trees=5) <= 1


def sequences(spark, seed, n=20, length=24):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=length)], [float(x) for x in rng.normal(size=length)]) for i in range(n)]
    return spark.createDataFrame(rows, "k long, hr array<double>, sbp array<double>")


def test_sequence_distance(spark):
    a, b = sequences(spark, 0), sequences(spark, 1)
    assert temporal.sequence_distance(a, b, "k", ["hr", "sbp"]).first()["mean_distance"] > 0
    assert temporal.sequence_distance(a, a, "k", ["hr", "sbp"]).first()["mean_distance"] == 0
    assert temporal.sequence_distance(a, b, "k", ["hr"], n_samples=5).first()["std_distance"] >= 0


def test_autocorrelation(spark):
    a = sequences(spark, 0, 50)
    got = {r["channel"]: r for r in temporal.compare_autocorrelations(a, sequences(spark, 1, 50), ["hr", "sbp"]).collect()}
    assert set(got) == {"hr", "sbp"} and got["hr"]["mean_diff"] > 0
    x = np.array(a.where("k = 3").first()["hr"])
    c = x - x.mean()
    want = [float((c[: len(c) - k] * c[k:]).sum() / (c * c).sum()) for k in range(13)]
    one = temporal.autocorrelations(a.where("k = 3"), ["hr"]).orderBy("lag").collect()
    assert [r["acf"] for r in one] == pytest.approx(want)
    flat = spark.createDataFrame([(1, [0.1] * 24)], "k long, hr array<double>")
    assert temporal.autocorrelations(flat, ["hr"]).count() == 0


def test_candidates(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0, 0.0), (2, 1.0, 0.5, 10.0), (3, None, 0.5, 1.0)], "t int, discriminator_auc double, tstr_auc double, frobenius_distance double")
    assert [r["t"] for r in evaluation.rank_candidates(df, 3).collect()] == [1, 2, 3]
    assert evaluation.rank_candidates(df, 2).collect()[1]["score"] == pytest.approx(2.0)


def test_full_evaluation_pools(spark):
    rng = np.random.default_rng(2)
    def people(n, seed):
        r = np.random.default_rng(seed)
        return [(int(i), float(r.integers(20, 90)), float(r.random() * 10 + 0.1), "ab"[int(r.integers(2))], int(r.random() < 0.4)) for i in range(n)]
    cols = "stay_id long, anchor_age double, los double, stroke_subtype string, hospital_expire_flag int"
    train, test = spark.createDataFrame(people(80, 1), cols), spark.createDataFrame(people(40, 2), cols)
    synth = None
    for d in range(2):
        part = spark.createDataFrame(people(40, 10 + d), cols).withColumnRenamed("stay_id", "row_id").withColumn("dataset_id", F.lit(d))
        synth = part if synth is None else synth.unionByName(part)
    found = evaluation.evaluate([evaluation.Model("x", synth)], train, test, {}, trees=5)
    names = {m for cols in evaluation.RESULT_TABLES.values() for m in cols}
    got = {(r["dataset_id"], r["metric"]) for r in found.collect()}
    assert {(d, m) for d in (0, 1) for m in names} <= got
    tables = evaluation.result_tables(found)
    assert "[" in tables["utility_results"].first()["auc_gap"] and rng is not None


def test_pair_moments_by_group(spark):
    """Missing values in either column, NULL and hot groups, more groups than a task holds."""
    from tidemark.operators import profiles

    rng = np.random.default_rng(2)
    x = rng.normal(5e6, 1, (600, 3))
    x[rng.random((600, 3)) < 0.2] = np.nan
    group = [None if i % 3 == 0 else f"g{i % 7}" for i in range(600)]
    rows = [(g, *[None if np.isnan(v) else float(v) for v in r]) for g, r in zip(group, x)]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double")
    held, profiles.HELD_GROUPS = profiles.HELD_GROUPS, 2
    try:
        got = {(r["g"], r["a"], r["b"]): r["r"] for r in profiles.correlations(df, ["a", "b", "c"], ["g"]).collect()}
    finally:
        profiles.HELD_GROUPS = held
    for g in set(group):
        own = x[[h == g for h in group]]
        for i, a in enumerate("abc"):
            for j, b in enumerate("abc"):
                ok = ~np.isnan(own[:, i]) & ~np.isnan(own[:, j])
                assert got[g, a, b] == pytest.approx(np.corrcoef(own[ok, i], own[ok, j])[0, 1], abs=1e-6)


def test_many_logistic_fits_at_once(spark):
    """Each model is at the optimum of its own penalised likelihood; AUC counts pairs, ties half."""
    from tidemark.operators import models

    rng = np.random.default_rng(5)
    x = rng.normal(3, 2, (300, 3))
    y = (x @ [1.0, -0.5, 0.0] + rng.normal(0, 2, 300) > 1.5).astype(float)
    member = [[0, 1] if i % 3 else [1, 2] for i in range(300)]
    df = spark.createDataFrame([(m, float(t), [float(v) for v in r]) for m, t, r in zip(member, y, x)], "models array<int>, label double, x array<double>")
    shift, scale = np.tile(x.mean(0), (3, 1)), np.tile(x.std(0), (3, 1))
    w = models.fit_logistics(df, shift, scale)
    for m in range(3):
        own = [i for i in range(300) if m in member[i]]
        z = np.c_[(x[own] - shift[m]) / scale[m], np.ones(len(own))]
        p = 1 / (1 + np.exp(-z @ w[m]))
        assert np.abs(z.T @ (p - y[own]) + np.append(w[m][:-1], 0)).max() < 1e-6
    scored = models.score_models(df, np.round(w, 0), shift, scale).toPandas()
    got = {r["model"]: r["auc"] for r in models.auc_by_model(spark.createDataFrame(scored.round(1))).collect()}
    for m, part in scored.round(1).groupby("model"):
        pos, neg = part.score[part.label == 1].to_numpy(), part.score[part.label == 0].to_numpy()
        diff = pos[:, None] - neg[None, :]
        assert got[m] == pytest.approx(((diff > 0) + 0.5 * (diff == 0)).mean())


def test_separable_rows_stay_finite(spark):
    from tidemark.operators import models

    df = spark.createDataFrame([([0], float(i >= 50), [float(i)]) for i in range(100)], "models array<int>, label double, x array<double>")
    w = models.fit_logistics(df, np.array([[49.5]]), np.array([[29.0]]))
    assert np.isfinite(w).all() and w[0, 0] > 2


def test_utility_of_many_datasets_is_that_of_each(spark):
    rng = np.random.default_rng(6)

    def side(n, seed_shift):
        f = rng.normal(seed_shift, 1, (n, 2))
        t = (f[:, 0] + rng.normal(0, 1, n) > seed_shift).astype(int)
        return [(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(f, t))]

    make = lambda rows: spark.createDataFrame(rows, "i long, f1 double, f2 double, flag int")
    train, test = make(side(150, 0)), make(side(80, 0))
    sets = [make(side(120, 0.5)), make(side(120, 0)), make([(1, 0.0, 0.0, 1), (2, 1.0, 1.0, 1)])]
    synth = None
    for d, s in enumerate(sets):
        s = s.withColumn("d", F.lit(d))
        synth = s if synth is None else synth.unionByName(s)
    many = utility.tstr_many(train, synth, test, "flag", ["f1", "f2"], "d", trees=5, max_depth=4)
    assert many[2] is None
    for d in (0, 1):
        one = utility.tstr(train, sets[d], test, "flag", ["f1", "f2"], trees=5, max_depth=4)
        assert many[d] == pytest.approx({k: one[k] for k in many[d]}, abs=0.02)


def test_terms_of_fits_are_read_from_arrow_slices():
    """A batch cut out of a longer one, with a row that trains no model."""
    import numpy as np
    import pyarrow as pa

    from tidemark.operators import models

    rows = [([0], 1.0, [1.0, 2.0]), ([0, 1], 0.0, [3.0, 1.0]), ([], 1.0, [9.0, 9.0]), ([1], 1.0, [0.5, 4.0])]
    whole = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], ["models", "label", "x"])
    w = np.array([[0.1, 0.2, 0.3], [0.0, -0.1, 0.2]])
    found = models._partial_fits(iter([whole.slice(1)]), w, np.zeros((2, 2)), np.ones((2, 2)))
    got = {(m, a): v for b in found for m, a, v in zip(*[c.to_pylist() for c in b.columns], strict=True)}
    z = np.array([[3.0, 1.0, 1.0], [0.5, 4.0, 1.0]])
    score = z @ w[1]
    assert abs(got[1, 0] - (np.logaddexp(0, score) - np.array([0.0, 1.0]) * score).sum()) < 1e-12
    assert abs(got[0, 0] - np.logaddexp(0, z[0] @ w[0])) < 1e-12
