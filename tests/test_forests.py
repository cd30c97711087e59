"""Forests grown in tasks: same trees however they are cut up, and as good as the library's."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from tidemark.operators import forests, privacy, utility
from tidemark.operators.forests import forest_scores
from tidemark.operators.models import assemble, auc


def rows(spark, seed, n=600):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=n) > 0).astype(int)
    made = [(float(a), float(b), float(round(c)), int(t)) for (a, b, c), t in zip(x, y)]
    return spark.createDataFrame(made, "f1 double, f2 double, f3 double, flag int")


def test_trees_do_not_depend_on_where_they_are_grown(spark):
    make = lambda d: utility.forest_rows(d, F.lit(0), "flag", ["f1", "f2", "f3"])
    train, test = make(rows(spark, 0)), make(rows(spark, 1, 100))

    def found(task_cells):
        out = forest_scores(train, test, ["x0", "x1", "x2"], 6, 1, 12, block_cells=100, task_cells=task_cells)
        return sorted((r["label"], r["n"], round(r["p1"], 9)) for r in out.collect())

    whole = found(100_000)
    assert sum(n for _, n, _ in whole) == 100
    assert found(60) == whole


def test_copies_count_as_rows(spark):
    # one cell of many rows draws the weight of that many rows: a class of 3 in 4 gives about that share
    many = spark.range(4000).select(F.lit(0).alias("forest"), (F.col("id") % 4 > 0).cast("int").alias("label"), F.lit(1.0).alias("x0"))
    r = forest_scores(many, many, ["x0"], 20, 3, 5).collect()
    assert sum(x["n"] for x in r) == 4000 and all(x["p1"] == pytest.approx(0.75, abs=0.02) for x in r)


def test_as_good_as_the_library(spark):
    train, test, cols = rows(spark, 2, 1500), rows(spark, 3, 800), ["f1", "f2", "f3"]
    model = RandomForestClassifier(numTrees=40, seed=1, maxDepth=12).fit(assemble(train, cols, "flag"))
    want = auc(model, assemble(test, cols, "flag"))
    assert utility.forest_aucs([train], test, "flag", cols, 40, 1, 12)[0] == pytest.approx(want, abs=0.02)


def test_the_driver_holds_no_forest(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("a forest was fitted into the driver")

    monkeypatch.setattr(RandomForestClassifier, "_fit", refuse)
    train, test = rows(spark, 4, 200), rows(spark, 5, 100)
    out = utility.tstr(train, rows(spark, 6, 200), test, "flag", ["f1", "f2", "f3"], trees=5)
    assert 0.5 < out["rf_trtr_auc"] <= 1
    assert 0.5 < privacy.attribute_inference(train, test, "flag", ["f1", "f2", "f3"], trees=5) <= 1


def test_cells_of_a_forest_that_fits_a_task_are_not_sent_per_tree(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("cells were dealt once per tree")

    make = lambda d: utility.forest_rows(d, F.lit(0), "flag", ["f1", "f2", "f3"])
    train, test = make(rows(spark, 0, 300)), make(rows(spark, 1, 100))
    want = sorted((r["label"], r["n"], round(r["p1"], 9)) for r in forest_scores(train, test, ["x0", "x1", "x2"], 6, 1, 12, 100, 60).collect())
    monkeypatch.setattr(forests, "_deal", refuse)
    got = forest_scores(train, test, ["x0", "x1", "x2"], 6, 1, 12, block_cells=100)
    assert sorted((r["label"], r["n"], round(r["p1"], 9)) for r in got.collect()) == want


@pytest.mark.parametrize("classes, most", [(2, 3), (5, 3), (2, 2**21)])
def test_nodes_cut_by_sorted_rows_are_those_of_histograms(monkeypatch, classes, most):
    rng = np.random.default_rng(7)
    bins, y = rng.integers(0, 32, (700, 6)).astype("uint8"), rng.integers(0, classes, 700)
    bins[:, 0], bins[:, 1] = bins[:, 0] % 2, bins[:, 1] // 16 * 31
    w = rng.integers(0, most, 700)
    law = forests.Law(1, 5, 30, 6, classes)
    made = []
    for few in (0, 30, 10**9):
        monkeypatch.setattr(forests, "FEW_ROWS", few)
        monkeypatch.setattr(forests, "NODES", 7)
        made.append([v.tolist() for v in forests.grow(bins, y, w, 1, 3, law)])
    assert len(made[0][0]) > 50 and made[0] == made[1] == made[2]
