"""Full real-against-synthetic evaluation over models and M datasets, pooled."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions.exprs import numeric_columns
from tidemark.operators import fidelity, plausibility, privacy, utility
from tidemark.operators.models import discriminator_aucs
from tidemark.operators.prep import invert_minmax
from tidemark.operators.stattests import pooled_text, rubin_pool, shared_numeric
from tidemark.operators.timeseries import series_summary
from tidemark.session import cut_lineage

UNDEFINED_UTILITY = {"trtr_auc": 0.0, "tstr_auc": 0.0, "auc_gap": 0.0}
EMPTY_PRIVACY = dict.fromkeys(["mia_f1", "mean_dcr", "median_dcr", "min_dcr", "p5_dcr", "aia_accuracy"], 0.0)


@dataclass
class Model:
    """Synthetic rows of one generator: all datasets in one table.

    ``normalised`` says whether values are on the scale of ``norm_params``.
    """

    name: str
    synth: DataFrame
    row_id: str = "row_id"
    dataset_id: str = "dataset_id"
    normalised: bool = False


def _for_datasets(real: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The real rows once per dataset, so that all datasets share a grouped job."""
    return real.withColumn("dataset_id", F.explode(F.array(*[F.lit(i) for i in ids])))


def _long(wide: DataFrame) -> DataFrame:
    names = [c for c in wide.columns if c != "dataset_id"]
    entries = F.array(
        *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names]
    )
    return wide.select("dataset_id", F.explode(entries).alias("e")).select("dataset_id", "e.*")


def fidelity_metrics(
    real: DataFrame, synth: DataFrame, ids: Sequence[int], cols: Sequence[str], category: str | None
) -> DataFrame:
    """Closed-form fidelity of every dataset: ``dataset_id, metric, value``."""
    by = ["dataset_id"]
    r = _for_datasets(real, ids)
    out = _long(fidelity.mean_pvalue(fidelity.dimension_wise(r, synth, cols, by), by)).unionByName(
        _long(fidelity.correlation_distance(r, synth, cols, by))
    )
    if category and category in real.columns and category in synth.columns:
        return out.unionByName(_long(fidelity.category_abundance(r, synth, category, by)))
    return out.unionByName(
        _long(synth.select("dataset_id").distinct().withColumn("mca_manhattan", F.lit(float("nan"))))
    )


def discriminator_metrics(real: DataFrame, synth: DataFrame, real_id: str, synth_id: str, cols: Sequence[str]) -> dict[int, float]:
    """AUC of telling real rows from those of each dataset, all models fitted at once."""
    tag = lambda d, i, *more: d.select(F.col(i).cast("string").alias("rid"), *cols, *more)
    found = discriminator_aucs(tag(real, real_id), tag(synth, synth_id, "dataset_id"), cols, ["rid"], "dataset_id")
    return {r["dataset_id"]: r["auc"] for r in found.collect()}


def utility_metrics(train: DataFrame, synth: DataFrame, ids: Sequence[int], test: DataFrame, target: str, skip: Sequence[str], **kw) -> dict[int, dict]:
    """Per dataset; zeros when the target is missing or the training rows hold one class."""
    zeros = {d: dict(UNDEFINED_UTILITY) for d in ids}
    if target not in synth.columns:
        return zeros
    cols = [c for c in shared_numeric(train, synth, [target, *skip, *vocab.ID_COLUMNS]) if c in test.columns]
    if not cols:
        return zeros
    return zeros | {d: m for d, m in utility.tstr_many(train, synth, test, target, cols, "dataset_id", **kw).items() if m}


def privacy_metrics(
    real: DataFrame, synth: DataFrame, sizes: Mapping[int, int], real_id: str, synth_id: str, cols: Sequence[str], **kw
) -> DataFrame:
    """Distances of all synthetic rows in one job, summarised per dataset."""
    rows = synth.withColumn("__id", F.concat_ws("|", F.col("dataset_id"), F.col(synth_id)))
    near = privacy.closest_record(real, rows, cols, real_id, "__id", **kw).select(
        F.substring_index("id", "|", 1).cast("int").alias("dataset_id"), "distance"
    )
    near = cut_lineage(near)
    attack = privacy.membership_from_distances(near, real, real_id, "dataset_id", sizes)
    return _long(privacy.dcr_summary(near, group=["dataset_id"])).unionByName(_long(attack.select("dataset_id", "mia_f1")))


def plausibility_by_dataset(model: Model, norm_params: Mapping | None) -> DataFrame:
    """Total violation rate of every dataset in one grouped job."""
    checked = plausibility.check_rules(
        model.synth, norm_params=norm_params if model.normalised else None, group=[model.dataset_id]
    )
    return checked.where(F.col("rule") == "total").select(
        F.col(model.dataset_id).alias("dataset_id"), F.lit("total_violation_rate").alias("metric"),
        F.col("violation_rate").alias("value"),
    )


def evaluate(
    models: Sequence[Model], train: DataFrame, test: DataFrame, norm_params: Mapping, real_id: str = "stay_id",
    target: str = "hospital_expire_flag", category: str = "stroke_subtype", trees: int = 100,
) -> DataFrame:
    """``model, dataset_id, metric, value`` for every model and dataset.

    ``train`` and ``test`` are on the original scale; normalised synthetic rows
    are brought back to it, so that all comparisons use one scale. Closed-form
    metrics are grouped jobs, logistic models of all datasets are fitted over the
    same passes, and their forests grow in the same jobs.
    """
    spark = train.sparkSession
    rows: list[tuple] = []
    grouped = None
    for m in models:
        named = m.synth.withColumnRenamed(m.dataset_id, "dataset_id")
        synth = cut_lineage(invert_minmax(named, norm_params) if m.normalised else named)
        sizes = {r[0]: r[1] for r in synth.groupBy("dataset_id").count().collect()}
        ids, skip = sorted(sizes), [real_id, m.row_id, "dataset_id", *vocab.ID_COLUMNS]
        parts = [plausibility_by_dataset(m, norm_params)]
        cols = shared_numeric(test, synth, skip)
        if cols:
            parts.append(fidelity_metrics(test, synth, ids, cols, category))
        private = sorted(shared_numeric(train, synth, skip))
        if private:
            parts.append(privacy_metrics(train, synth, sizes, real_id, m.row_id, private))
        quasi = [c for c in private if c != target][: 10 if m.normalised else 8]
        found = utility_metrics(train, synth, ids, test, target, [real_id, m.row_id, "dataset_id"], trees=trees)
        if cols:
            for d, v in discriminator_metrics(test, synth, real_id, m.row_id, cols).items():
                found[d]["discriminator_auc"] = v
        if private:
            for d, v in privacy.attribute_inference_many(train, synth, "dataset_id", ids, target, quasi).items():
                found[d]["aia_accuracy"] = v
        else:
            for d in ids:
                found[d] |= EMPTY_PRIVACY
        rows += [(m.name, int(d), k, float(v)) for d in ids for k, v in found[d].items()]
        for part in parts:
            part = part.select(F.lit(m.name).alias("model"), F.col("dataset_id").cast("int").alias("dataset_id"), "metric", "value")
            grouped = part if grouped is None else grouped.unionByName(part)
    made = spark.createDataFrame(rows, "model string, dataset_id int, metric string, value double")
    return made.unionByName(grouped)


# --- fixed values: metrics of the published tables ---
RESULT_TABLES = {
    "fidelity_comparison": ["avg_ks_pvalue", "frobenius_distance", "discriminator_auc", "mca_manhattan"],
    "plausibility_rules": ["total_violation_rate"],
    "utility_results": ["trtr_auc", "tstr_auc", "auc_gap"],
    "privacy_metrics": ["mia_f1", "mean_dcr", "median_dcr", "p5_dcr", "aia_accuracy"],
}


def result_tables(metrics: DataFrame) -> dict[str, DataFrame]:
    """One row per model, pooled metrics as ``est [lo, hi]`` text."""
    pooled = rubin_pool(metrics).withColumn(
        "text", pooled_text(F.col("pooled_estimate"), F.col("ci_lower"), F.col("ci_upper"))
    )
    return {
        name: pooled.groupBy("model").agg(*[F.max(F.when(F.col("metric") == m, F.col("text"))).alias(m) for m in cols])
        for name, cols in RESULT_TABLES.items()
    }


# ---- candidate scores -----------------------------------------------------
def composite_score(auc: Column, tstr: Column, frobenius: Column) -> Column:
    """|AUC − ½| + (1 − TSTR) + Frobenius / 10; lower is better."""
    return F.abs(auc - F.lit(0.5)) + (F.lit(1.0) - tstr) + frobenius / F.lit(10.0)


def rank_candidates(candidates: DataFrame, k: int = 5) -> DataFrame:
    """Best ``k`` candidates by composite score; missing scores go last."""
    score = composite_score(F.col("discriminator_auc"), F.col("tstr_auc"), F.col("frobenius_distance"))
    ties = [F.col(c) for c in candidates.columns[:1]]
    return candidates.withColumn("score", score).orderBy(F.col("score").asc_nulls_last(), *ties).limit(k)


def score_candidate(
    real_series: DataFrame, synth_series: DataFrame, static: DataFrame, test: DataFrame, key: str, channels: Sequence[str],
    target: str = "hospital_expire_flag",
) -> dict[str, float]:
    """Score a generator on static columns plus per-entity mean and std of every
    channel; a metric that cannot be computed takes its worst value. Test rows
    have no series and enter with zeros."""
    meta = numeric_columns(static, [key, target, *vocab.ID_COLUMNS])
    flat = lambda s: cut_lineage(static.select(key, target, *meta).join(series_summary(s, [key], channels), key))
    real, synth = flat(real_series), flat(synth_series)
    cols = [c for c in real.columns if c not in (key, target)]
    zeros = [F.lit(0.0).alias(f"{c}_{s}") for c in channels for s in ("mean", "std")]
    held_out = test.select(key, target, *meta, *zeros)
    out = {"discriminator_auc": 1.0, "tstr_auc": 0.5, "frobenius_distance": 10.0}
    if real.isEmpty() or synth.isEmpty():
        return out
    tagged = lambda d: d.select(F.col(key).cast("string").alias("rid"), *cols)
    found = fidelity.discriminator(tagged(real), tagged(synth), cols, ["rid"])["auc"]
    out["discriminator_auc"] = found if math.isfinite(found) else 1.0
    out["frobenius_distance"] = float(fidelity.correlation_distance(real, synth, cols).first()[0])
    try:
        out["tstr_auc"] = utility.tstr(real, synth, held_out, target, cols)["tstr_auc"]
    except utility.SingleClass:
        pass
    return out
