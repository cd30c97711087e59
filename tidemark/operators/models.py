"""Classifiers of the utility and fidelity metrics: logistic models, one by ``pyspark.ml`` or many at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.prep import apply_standard
from tidemark.operators.skew import fit_blocks, hash_rank, running_sums, value_sums
from tidemark.session import cut_lineage


def assemble(df: DataFrame, cols: Sequence[str], label: str, scaler: dict | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """(extra..., label, features), standardised with fitted moments."""
    base = df.select(
        *extra,
        F.col(label).cast("double").alias("label"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(cols)],
    )
    if scaler:
        base = apply_standard(base, {f"x{i}": scaler[c] for i, c in enumerate(cols)})
    names = [f"x{i}" for i in range(len(cols))]
    return VectorAssembler(inputCols=names, outputCol="features").transform(base).select(*extra, "label", "features")


def logistic(train: DataFrame):
    """L2-penalised logistic fit with unit inverse strength (penalty 1/n per row)."""
    n = max(train.count(), 1)
    return LogisticRegression(regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=200).fit(train)


def n_classes(df: DataFrame) -> int:
    return df.select("label").distinct().limit(2).count()


def auc(model, test: DataFrame) -> float:
    # numBins=0: rank every distinct score instead of a down-sampled curve
    return float(BinaryClassificationEvaluator(numBins=0).evaluate(model.transform(test)))


# ---- many logistic fits in one pass ----------------------------------------
def _partial_fits(batches: Iterator, weights: np.ndarray, shift: np.ndarray, scale: np.ndarray) -> Iterator:
    """Per model the penalised-likelihood terms of this task's rows: loss, gradient and Hessian as one array.

    Lists are read from Arrow as flat arrays: no row becomes an object of its own, in any of the passes.
    """
    import pyarrow as pa

    n_models, wide = weights.shape
    total = np.zeros((n_models, 1 + wide + wide * wide))
    seen = np.zeros(n_models, bool)
    for b in batches:
        if not b.num_rows:
            continue
        x = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, wide - 1)
        y = b["label"].to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(b.num_rows), b["models"].value_lengths().to_numpy(zero_copy_only=False))
        model = b["models"].flatten().to_numpy(zero_copy_only=False).astype(int)
        order = np.argsort(model, kind="stable")
        found, starts = np.unique(model[order], return_index=True)
        for m, rows in zip(found, np.split(row[order], starts[1:])):
            z = np.concatenate([(x[rows] - shift[m]) / scale[m], np.ones((len(rows), 1))], axis=1)
            score = z @ weights[m]
            p = 1.0 / (1.0 + np.exp(-np.clip(score, -500, 500)))
            loss = (np.logaddexp(0.0, score) - y[rows] * score).sum()
            hessian = (z * (p * (1 - p))[:, None]).T @ z
            total[m] += np.concatenate([[loss], z.T @ (p - y[rows]), hessian.ravel()])
            seen[m] = True
    for m in np.flatnonzero(seen):
        at = np.arange(total.shape[1], dtype="int32")
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), m, "int32")), pa.array(at), pa.array(total[m])], ["model", "at", "v"])


def fit_logistics(rows: DataFrame, shift: np.ndarray, scale: np.ndarray, steps: int = 50, tolerance: float = 1e-9) -> np.ndarray:
    """Weights (last: intercept) of many L2-penalised logistic models, all fitted by Newton steps over the same passes.

    ``rows``: models (the numbers of the models a row trains), label, x. Model m sees (x - shift[m]) / scale[m]. The penalty is
    half the squared weights, without the intercept. A pass adds up loss, gradient and Hessian of all models; the driver solves
    one small system per model. A step that raises the loss is halved.
    """
    n_models, width = shift.shape
    wide = width + 1
    weights, last, before = np.zeros((n_models, wide)), np.zeros((n_models, wide)), np.full(n_models, np.inf)
    ridge = np.append(np.ones(width), 0.0)
    open_ = np.ones(n_models, bool)
    for _ in range(steps):
        now = weights.copy()
        sums = rows.mapInArrow(lambda b, w=now: _partial_fits(b, w, shift, scale), "model int, at int, v double")
        terms = np.zeros((n_models, 1 + wide + wide * wide))
        for r in sums.groupBy("model", "at").agg(F.sum("v").alias("v")).collect():
            terms[r["model"], r["at"]] = r["v"]
        for m in np.flatnonzero(open_):
            loss = terms[m, 0] + 0.5 * (ridge * weights[m] ** 2).sum()
            if loss > before[m] + 1e-9 * abs(before[m]):
                weights[m] = (weights[m] + last[m]) / 2
                continue
            gradient = terms[m, 1 : 1 + wide] + ridge * weights[m]
            hessian = terms[m, 1 + wide :].reshape(wide, wide) + np.diag(ridge + 1e-12)
            step = np.linalg.solve(hessian, gradient)
            last[m], before[m] = weights[m], loss
            weights[m] = weights[m] - step
            open_[m] = np.abs(step).max() > tolerance
        if not open_.any():
            break
    return weights


def score_models(rows: DataFrame, weights: np.ndarray, shift: np.ndarray, scale: np.ndarray) -> DataFrame:
    """``model, label, score``: each row (models, label, x) under each of its models."""
    raw = weights[:, :-1] / scale
    rest = weights[:, -1] - (raw * shift).sum(1)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            each = b.explode("models").dropna(subset=["models"])
            if len(each):
                m = each["models"].to_numpy().astype(int)
                x = np.stack(each["x"].to_numpy())
                yield pd.DataFrame({"model": m.astype("int32"), "label": each["label"].to_numpy(), "score": (x * raw[m]).sum(1) + rest[m]})

    return rows.mapInPandas(scored, "model int, label double, score double")


def auc_by_model(scored: DataFrame, weight: str | None = None) -> DataFrame:
    """``model, auc``: the share of (positive, negative) pairs in the right order, ties half; NULL with one class.

    A row counts ``weight`` times (once by default).
    Equal scores collapse and running counts go by value blocks, so a model is never ranked in one task.
    """
    edges = fit_blocks(scored, ["score"])
    times = F.col(weight) if weight else F.lit(1)
    both = {"pos": F.col("label") * times, "neg": (1 - F.col("label")) * times}
    counts = running_sums(value_sums(scored, ["model"], ["score"], edges, both), ["model", "variable"], ["neg"], edges is not None)
    right = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return counts.groupBy("model").agg(F.try_divide(right, F.sum("pos") * F.sum("neg").cast("double")).alias("auc"))


def moments_of(df: DataFrame, cols: Sequence[str], by: str | None) -> dict:
    """Rows, sums and sums of squares per group; NULL counts as 0."""
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]
    found = df.groupBy(*([by] if by else [])).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(v) for v in x]).alias("m"), F.array(*[F.var_pop(v) for v in x]).alias("v")
    )
    return {r[by] if by else None: (r["n"], np.array(r["m"], float), np.array(r["v"], float)) for r in found.collect() if r["n"]}


def discriminator_aucs(
    real: DataFrame, synth: DataFrame, cols: Sequence[str], ids: Sequence[str], dataset: str, folds: int = 5, seed: int = 42
) -> DataFrame:
    """``dataset, auc, auc_std``: how well a logistic model tells real rows from those of each synthetic dataset.

    Mean and population std over stratified folds by hashed rank. The models of all datasets and folds are fitted at once; real
    rows are kept once and list the models they train.
    """
    cols = list(cols)
    numbers = sorted(r[0] for r in synth.select(dataset).distinct().collect())  # one per dataset
    at = F.lit(-1)
    for i, d in enumerate(numbers):
        at = F.when(F.col(dataset) == d, F.lit(i)).otherwise(at)
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]).alias("x")
    both = real.select(*ids, F.lit(1.0).alias("label"), F.lit(-1).alias("d"), x).unionByName(
        synth.select(*ids, F.lit(0.0).alias("label"), at.alias("d"), x)
    )
    ranked = hash_rank(both, [*ids, "label"], seed, ["label", "d"]).withColumn("fold", (F.col("rank") % folds).cast("int"))
    every = F.array(*[F.lit(i) for i in range(len(numbers))])
    own = F.when(F.col("d") < 0, every).otherwise(F.array("d"))
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))
    train = F.flatten(F.transform(own, lambda i: F.transform(others, lambda f: i * folds + f)))
    rows = cut_lineage(ranked.select("label", "x", train.alias("models"), F.transform(own, lambda i: i * folds + F.col("fold")).alias("tests")))

    n, m, v = moments_of(real, cols, None)[None]
    shift, scale = np.zeros((len(numbers) * folds, len(cols))), np.ones((len(numbers) * folds, len(cols)))
    for d, (k, mk, vk) in moments_of(synth, cols, dataset).items():
        mean = (n * m + k * mk) / (n + k)
        var = (n * (v + (m - mean) ** 2) + k * (vk + (mk - mean) ** 2)) / (n + k)
        i = numbers.index(d) * folds
        shift[i : i + folds], scale[i : i + folds] = mean, np.where(var > 0, np.sqrt(var), 1.0)
    weights = fit_logistics(rows.select("models", "label", "x"), shift, scale)
    scored = cut_lineage(score_models(rows.select(F.col("tests").alias("models"), "label", "x"), weights, shift, scale))
    aucs = auc_by_model(scored).withColumn("d", F.floor(F.col("model") / folds).cast("int"))
    name = F.get(F.array(*[F.lit(d) for d in numbers]), F.col("d"))
    return aucs.groupBy("d").agg(F.avg("auc").alias("auc"), F.stddev_pop("auc").alias("auc_std")).select(name.alias(dataset), "auc", "auc_std")
