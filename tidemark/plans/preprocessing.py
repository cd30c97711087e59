"""Cohort stages to model-ready splits, parameters fitted on train only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions.exprs import numeric_columns
from tidemark.operators import prep
from tidemark.operators.timeseries import clip_channels, forward_fill, forward_fill_bounded
from tidemark.session import cut_lineage
from tidemark.sources.writers import save_params, write_stage


@dataclass
class Prepared:
    train: DataFrame
    val: DataFrame
    test: DataFrame
    series: DataFrame | None
    norm_params: dict
    fills: dict
    categories: dict


def preprocess_series(
    series: DataFrame, key: str = "stay_id", hour: str = "hour", hour_capped: bool = False
) -> DataFrame:
    """Forward fill inside each stay, then clip to physiological ranges.

    ``hour_capped`` states that the series has one row per stay and hour up to a
    cap, as the extraction jobs make it; otherwise long stays are cut in blocks.
    """
    present = [c for c in vocab.CHANNELS if c in series.columns]
    fill = forward_fill_bounded if hour_capped else forward_fill
    return clip_channels(fill(series, [key], hour, present))


def preprocess(
    static: DataFrame,
    series: DataFrame | None = None,
    ids: Sequence[str] = ("stay_id",),
    target: str = "hospital_expire_flag",
    test_size: float = 0.2,
    val_size: float = 0.1,
    seed: int = 42,
    method: str = "median",
    drop: Sequence[str] = vocab.NON_MODEL_COLUMNS,
    categorical: Sequence[str] = vocab.CATEGORICAL_COLUMNS,
    id_columns: Sequence[str] = vocab.ID_COLUMNS,
) -> Prepared:
    """Drop → split → impute → encode → normalise, plus the series.

    Categories come from the training rows, so all three splits get the same,
    sorted columns; an unseen category is all zeros.
    """
    marked = cut_lineage(prep.stratified_split(static.drop(*drop), list(ids), target, test_size, val_size, seed))
    train_rows = marked.where(F.col("split") == "train").drop("split")
    fills = prep.fit_imputation(train_rows, method, exclude=[*id_columns, target])
    categories = prep.fit_categories(prep.apply_imputation(train_rows, fills, flag_labs=False), categorical)
    ready = prep.one_hot(prep.apply_imputation(marked, fills), categories)
    names = sorted(c for c in ready.columns if c != "split")
    ready = ready.select("split", *[F.col(f"`{c}`") for c in names])
    skip = {*id_columns, target}
    scaled = [
        c for c in numeric_columns(ready, skip) if not c.startswith("has_") and not c.endswith("_missing")
    ]
    params = prep.fit_minmax(ready.where(F.col("split") == "train"), scaled)
    done = prep.apply_minmax(ready, params)
    part = lambda s: done.where(F.col("split") == s).drop("split")
    return Prepared(
        part("train"), part("val"), part("test"), None if series is None else preprocess_series(series),
        params, fills, categories,
    )


def write_prepared(p: Prepared, folder: str) -> None:
    """Stage files: three splits, the series and the normalisation parameters."""
    for name, df in (("train", p.train), ("val", p.val), ("test", p.test)):
        write_stage(df, f"{folder}/static_features_{name}.parquet")
    if p.series is not None:
        write_stage(p.series, f"{folder}/timeseries_processed.parquet")
    save_params(p.train.sparkSession, p.norm_params, f"{folder}/norm_params.json")


def splits_or_new(static: DataFrame, stored: dict[str, DataFrame] | None, ids: Sequence[str], target: str) -> tuple[DataFrame, DataFrame]:
    """Stored train/test rows when both exist, else a stratified 80/20 split."""
    if stored and {"train", "test"} <= stored.keys():
        return stored["train"], stored["test"]
    marked = prep.stratified_split(static, list(ids), target, 0.2, 0.0)
    return tuple(marked.where(F.col("split") == s).drop("split") for s in ("train", "test"))
