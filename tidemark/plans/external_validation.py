"""External validation run: check inputs, cohort, series, comparison, files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from tidemark.plans.cohort_jobs import extract_freetext_cohort, extract_periodic_timeseries
from tidemark.plans.comparison import compare_cohorts
from tidemark.sources.readers import require
from tidemark.sources.writers import write_result_csv, write_stage


def validate_externally(
    tables: Mapping[str, DataFrame], folder: str, primary: DataFrame | None = None, with_series: bool = True,
    min_los_hours: float = 6, max_los_days: float = 30, max_hours: int = 72,
) -> dict[str, DataFrame]:
    """Writes and returns ``cohort`` and, where asked for, ``timeseries`` and ``comparison``."""
    require(tables, {"patient": ["patientunitstayid"], "diagnosis": ["patientunitstayid"]})
    cohort = write_stage(extract_freetext_cohort(tables, min_los_hours, max_los_days), f"{folder}/cohort.parquet")
    if cohort.isEmpty():
        raise ValueError("no qualifying patients in the external source")
    out = {"cohort": cohort}
    if with_series:
        ts = extract_periodic_timeseries(cohort, tables["vitals"], tables["gcs"], max_hours)
        out["timeseries"] = write_stage(ts, f"{folder}/timeseries.parquet")
    if primary is not None:
        out["comparison"] = compare_cohorts(primary, cohort)
        write_result_csv(out["comparison"], f"{folder}/cohort_comparison.csv", ["metric"])
    return out
