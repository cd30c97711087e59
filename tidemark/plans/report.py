"""Cohort report: result tables and the numbers behind the plots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions.exprs import bin_label
from tidemark.operators import profiles
from tidemark.operators.stattests import chi_square, kruskal_wallis, p_text
from tidemark.sources.writers import write_result_csv


def default_rows(df: DataFrame) -> tuple[dict[str, str], list]:
    """Continuous rows and level rows of the standard Table 1."""
    continuous = {"anchor_age": "Age (years)", **vocab.LAB_LABELS, "los": "ICU LOS (days)"}
    continuous = {c: t for c, t in continuous.items() if c in df.columns}
    levels = [(f"Gender — {g}", f"gender_{g}", F.col("gender") == g) for g in ("F", "M")]
    levels += [
        (f"Stroke subtype — {vocab.SUBTYPE_LABELS[s]}", f"subtype_{s}", F.col("stroke_subtype") == s)
        for s in vocab.SUBTYPES
    ]
    levels += [(t, c, F.col(c) == 1) for c, t in vocab.COMORBIDITY_LABELS.items()]
    levels += [("In-hospital mortality", "mortality", F.col("hospital_expire_flag") == 1)]
    return continuous, levels


def group_tests(
    df: DataFrame, group: str, groups: Sequence, continuous: Mapping[str, str], categorical: Mapping[str, str]
) -> DataFrame:
    """``variable (label), p_value`` text: Kruskal–Wallis or chi-square per row."""
    parts = []
    if continuous:
        parts.append((kruskal_wallis(df, list(continuous), group, groups), continuous))
    if categorical:
        parts.append((chi_square(df, list(categorical), group), categorical))
    out = None
    for tests, labels in parts:
        label = F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col("variable"))
        rows = tests.select(label.alias("variable"), p_text(F.col("pvalue")).alias("p_value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def stratified_table_one(df: DataFrame, group: str, groups: Sequence, tested: Mapping[str, str]) -> DataFrame:
    """Table 1 with one column per group and a p-value column."""
    continuous, levels = default_rows(df)
    table = profiles.side_by_side(profiles.table_one(df, continuous, levels, [group]), group, groups)
    return table.join(group_tests(df, group, groups, continuous, tested), "variable", "left")


def cohort_report(static: DataFrame, series: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of the report, lazily."""
    continuous, levels = default_rows(static)
    flags = [c for c in vocab.COMORBIDITY_LABELS if c in static.columns]
    tested = {"gender": "Gender — F", **{c: vocab.COMORBIDITY_LABELS[c] for c in flags}}
    numeric = [c for c in ["anchor_age", "los", *vocab.LAB_COLUMNS] if c in static.columns]
    cats = [c for c in vocab.CATEGORICAL_COLUMNS if c in static.columns]
    decade = bin_label("anchor_age", list(range(10, 110, 10)), [f"({a}, {a + 10}]" for a in range(10, 100, 10)], True)
    out = {
        "table1_overall": profiles.table_one(static, continuous, levels),
        "table1_by_subtype": stratified_table_one(
            static, "stroke_subtype", vocab.SUBTYPES, {**tested, "hospital_expire_flag": "In-hospital mortality"}
        ),
        "table1_by_mortality": stratified_table_one(
            static, "hospital_expire_flag", [0, 1], {**tested, "stroke_subtype": "Stroke subtype — Ischemic"}
        ),
        "comorbidity_cooccurrence": profiles.cooccurrence(static, flags),
        "numeric_profile": profiles.numeric_profile(static, numeric),
        "category_profile": profiles.category_profile(static, cats),
        "binary_profile": profiles.binary_profile(static, [*flags, "hospital_expire_flag"]),
        "mortality_by_subtype": profiles.group_mean(static, ["stroke_subtype"], ["hospital_expire_flag"]),
        "mortality_by_age": profiles.binned_rate(static, decade, "hospital_expire_flag"),
        "comorbidity_by_age": profiles.prevalence_by_bin(
            static, bin_label("anchor_age", *vocab.AGE_GROUPS, right_closed=True), flags
        ),
        "correlations": profiles.correlations(
            static, [c for c in [*vocab.METADATA_COLUMNS, *vocab.LAB_COLUMNS] if c in static.columns]
        ),
        "los_by_subtype": profiles.capped_five_numbers(static, "los", "stroke_subtype"),
        "top_race": profiles.top_categories(static, "race") if "race" in static.columns else None,
    }
    if series is not None:
        present = [c for c in vocab.CHANNELS if c in series.columns]
        dims = static.select("stay_id", "stroke_subtype", "hospital_expire_flag").dropDuplicates(["stay_id"])
        joined = series.join(dims, "stay_id")
        out["series_missing"] = profiles.missing_rates(series, present)
        out["gcs_by_subtype"] = profiles.trajectory_mean(joined, ["stroke_subtype"], "hour", ["gcs_total"], 72)
        out["vitals_by_outcome"] = profiles.trajectory_mean(joined, ["hospital_expire_flag"], "hour", ["hr", "sbp"], 48)
    return {k: v for k, v in out.items() if v is not None}


def write_report(tables: Mapping[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        write_result_csv(df, f"{folder}/{name}.csv", df.columns[:1])
