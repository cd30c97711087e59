"""Downstream utility: train on synthetic, test on real."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import numeric_columns
from tidemark.operators.forests import forest_scores
from tidemark.operators.models import assemble, auc, auc_by_model, fit_logistics, logistic, moments_of, n_classes, score_models
from tidemark.operators.prep import fit_standard
from tidemark.session import cut_lineage


class SingleClass(ValueError):
    """Training rows hold one class only."""


def tstr(
    real_train: DataFrame,
    synth: DataFrame,
    real_test: DataFrame,
    target: str,
    cols: Sequence[str] | None = None,
    trees: int = 100,
    seed: int = 42,
    max_depth: int = 30,
) -> dict[str, float]:
    """AUC of models trained on real / synthetic rows, both tested on real rows.

    Each training set brings its own scaler, also for the test rows. A test set
    with one class scores 0.5; a training set with one class is an error.
    """
    cols = list(cols or [c for c in numeric_columns(real_train, [target]) if c in synth.columns])
    runs = {}
    for tag, train in (("trtr", real_train), ("tstr", synth)):
        scaler = fit_standard(train, cols)
        fit_on = assemble(train, cols, target, scaler).persist()
        test = assemble(real_test, cols, target, scaler).persist()
        try:
            if n_classes(fit_on) < 2:
                raise SingleClass("training rows hold a single class")
            defined = n_classes(test) == 2
            runs["lr", tag] = auc(logistic(fit_on), test) if defined else 0.5
        finally:
            fit_on.unpersist()
            test.unpersist()
    grown = forest_aucs([real_train, synth], real_test, target, cols, trees, seed, max_depth) if defined else [0.5, 0.5]
    runs |= {("rf", tag): grown[i] for i, tag in enumerate(("trtr", "tstr"))}
    out: dict[str, float] = {}
    for name in ("lr", "rf"):
        a, b = runs[name, "trtr"], runs[name, "tstr"]
        out |= {f"{name}_trtr_auc": a, f"{name}_tstr_auc": b, f"{name}_gap": abs(a - b)}
    out["trtr_auc"] = (runs["lr", "trtr"] + runs["rf", "trtr"]) / 2
    out["tstr_auc"] = (runs["lr", "tstr"] + runs["rf", "tstr"]) / 2
    out["auc_gap"] = abs(out["trtr_auc"] - out["tstr_auc"])
    return out


def forest_rows(df: DataFrame, forest: Column, target: str, cols: Sequence[str]) -> DataFrame:
    return df.select(forest.alias("forest"), F.col(target).cast("double").alias("label"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(cols)])


def forest_aucs(
    trains: Sequence[DataFrame], test: DataFrame, target: str, cols: Sequence[str], trees: int, seed: int, max_depth: int
) -> list[float]:
    """AUC on ``test`` of one forest per training table, all grown in the same jobs."""
    rows = None
    for i, t in enumerate(trains):
        side = forest_rows(t, F.lit(i), target, cols)
        rows = side if rows is None else rows.unionByName(side)
    every = F.explode(F.array(*[F.lit(i) for i in range(len(trains))]))
    names = [f"x{i}" for i in range(len(cols))]
    scores = forest_scores(rows, forest_rows(test, every, target, cols), names, trees, seed, max_depth)
    found = auc_by_model(scores.select(F.col("forest").alias("model"), "label", F.col("p1").alias("score"), "n"), "n")
    aucs = {r["model"]: r["auc"] for r in found.collect()}
    return [float(aucs[i]) for i in range(len(trains))]


def tstr_many(
    real_train: DataFrame, synth: DataFrame, real_test: DataFrame, target: str, cols: Sequence[str], dataset: str,
    trees: int = 100, seed: int = 42, max_depth: int = 30,
) -> dict[int, dict[str, float] | None]:
    """``tstr`` of every dataset of ``synth``: trtr_auc, tstr_auc and auc_gap, None where training rows hold one class.

    The models trained on real rows are fitted once. All logistic models share their passes over the rows.
    """
    cols = list(cols)
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]).alias("x")
    label = F.col(target).cast("double").alias("label")
    sides = {None: real_train} | {d: synth.where(F.col(dataset) == d) for d in sorted(r[0] for r in synth.select(dataset).distinct().collect())}
    number = {d: i for i, d in enumerate(sides)}
    at = F.lit(-1)
    for d, i in number.items():
        if d is not None:
            at = F.when(F.col(dataset) == d, F.lit(i)).otherwise(at)
    rows = real_train.select(F.array(F.lit(0)).alias("models"), label, x).unionByName(synth.select(F.array(at).alias("models"), label, x))
    rows = cut_lineage(rows.where(F.col("label").isNotNull()))
    classes = {r["m"]: r["n"] for r in rows.groupBy(F.get("models", F.lit(0)).alias("m")).agg(F.countDistinct("label").alias("n")).collect()}
    test = cut_lineage(real_test.select(F.array(*[F.lit(i) for i in number.values()]).alias("models"), label, x))
    if test.select("label").distinct().limit(2).count() < 2:
        even = {"trtr_auc": 0.5, "tstr_auc": 0.5, "auc_gap": 0.0}
        return {d: dict(even) if classes.get(0) == classes.get(number[d]) == 2 else None for d in sides if d is not None}
    moments = moments_of(real_train, cols, None) | moments_of(synth, cols, dataset)
    shift = np.array([moments[d][1] if d in moments else np.zeros(len(cols)) for d in sides])
    scale = np.array([np.where(moments[d][2] > 0, np.sqrt(moments[d][2]), 1.0) if d in moments else np.ones(len(cols)) for d in sides])
    found = auc_by_model(cut_lineage(score_models(test, fit_logistics(rows, shift, scale), shift, scale))).collect()
    linear = {r["model"]: r["auc"] for r in found}

    able = [d for d in sides if classes.get(number[d], 0) >= 2]
    grown = dict.fromkeys(sides, float("nan"))
    if able:
        grown |= dict(zip(able, forest_aucs([sides[d] for d in able], real_test, target, cols, trees, seed, max_depth)))
    out: dict[int, dict[str, float] | None] = {}
    for d in sides:
        if d is not None:
            trtr, tstr_ = ((linear[number[k]] + grown[k]) / 2 for k in (None, d))
            good = classes.get(0) == classes.get(number[d]) == 2
            out[d] = {"trtr_auc": trtr, "tstr_auc": tstr_, "auc_gap": abs(trtr - tstr_)} if good else None
    return out
