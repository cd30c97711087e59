"""Extraction jobs: coded cohort, static features, hourly series, free-text cohort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions.exprs import (
    celsius_guarded,
    code_ladder,
    code_match,
    fahrenheit_to_celsius,
    flag_equals,
    hour_of_offset,
    map_values,
    number_or_leading_digits,
    parse_with_sentinel,
    round_scaled,
    strict_sum,
    text_ladder,
    text_match,
)
from tidemark.operators.cohort import (
    best_record,
    code_flags,
    dictionary_join,
    first_record,
    first_values_in_window,
    key_map,
    restrict_to,
    star_join,
    within_los,
)
from tidemark.operators.prep import conform
from tidemark.operators.timeseries import hourly_column_medians, hourly_medians, with_hour
from tidemark.sources.readers import require

COHORT_COLUMNS = [
    "subject_id", "hadm_id", "icd_code", "icd_version", "seq_num", "icd_title", "stay_id", "first_careunit",
    "intime", "outtime", "los", "gender", "anchor_age", "dod", "admittime", "dischtime", "deathtime",
    "admission_type", "admission_location", "discharge_location", "insurance", "race", "hospital_expire_flag",
]


def extract_cohort(
    tables: Mapping[str, DataFrame],
    min_los_hours: float = 6,
    max_los_days: float = 30,
    prefixes: Mapping[int, Sequence[str]] = vocab.COHORT_PREFIXES,
    exact: Mapping[int, Sequence[str]] = vocab.COHORT_EXACT,
) -> DataFrame:
    """First qualifying stay per subject.

    ``tables``: diagnoses, dictionary, stays, patients, admissions. Of several
    codes of the same stay the lowest ``seq_num`` is kept, then the lowest code.
    """
    require(
        tables,
        {
            "diagnoses": ["subject_id", "hadm_id", "icd_code", "icd_version", "seq_num"],
            "dictionary": ["icd_code", "icd_version", "long_title"],
            "stays": ["subject_id", "hadm_id", "stay_id", "intime", "outtime", "los", "first_careunit"],
            "patients": ["subject_id", "gender", "anchor_age", "dod"],
            "admissions": ["hadm_id", "admittime", "dischtime", "deathtime", "hospital_expire_flag"],
        },
    )
    # repeated diagnosis rows need no distinct: only the first row per subject stays
    dx = tables["diagnoses"].where(code_match("icd_code", "icd_version", prefixes, exact)).select(
        "subject_id", "hadm_id", "icd_code", "icd_version", "seq_num"
    )
    titles = tables["dictionary"].select("icd_code", "icd_version", F.col("long_title").alias("icd_title"))
    dx = dictionary_join(dx, titles, ["icd_code", "icd_version"])
    stays = tables["stays"].where(within_los(F.col("los"), min_los_hours, max_los_days)).select(
        "subject_id", "hadm_id", "stay_id", "first_careunit", "intime", "outtime", "los"
    )
    admissions = tables["admissions"].select(
        *[c for c in ["hadm_id", *COHORT_COLUMNS[14:]] if c in tables["admissions"].columns]
    )
    # a stay without an admission cannot win, so that join comes before the ranking;
    # a missing patient removes all rows of a subject, so that one can wait
    qualifying = dx.join(stays.join(admissions, "hadm_id"), ["subject_id", "hadm_id"])
    first = first_record(qualifying, "subject_id", "intime", ["seq_num", "icd_code", "icd_version", "stay_id"])
    wide = first.join(tables["patients"].select("subject_id", "gender", "anchor_age", "dod"), "subject_id")
    return wide.select(*[c for c in COHORT_COLUMNS if c in wide.columns])


def extract_static_features(
    cohort: DataFrame,
    diagnoses: DataFrame,
    labs: DataFrame,
    window: str = "24 HOURS",
    flags: Mapping = vocab.COMORBIDITY_PREFIXES,
    ladder: Sequence[tuple] = vocab.SUBTYPE_LADDER,
    lab_items: Mapping[int, str] = vocab.LAB_ITEMS,
    lab_ties: Sequence[str] = (),
) -> DataFrame:
    """Cohort plus comorbidity flags, subtype and first laboratory values.

    The cohort is read twice; pass it as a written stage.
    """
    on = ["subject_id", "hadm_id"]
    flagged = code_flags(cohort, diagnoses, on, flags)
    first_labs = first_values_in_window(
        cohort, labs, on, "admittime", window, "itemid", lab_items, "valuenum", "charttime", lab_ties
    )
    subtype = code_ladder("icd_code", "icd_version", ladder, "other")
    return star_join(flagged.withColumn("stroke_subtype", subtype), on, first_labs).select(
        *cohort.columns, *flags, "stroke_subtype", *lab_items.values()
    )


def extract_timeseries(
    cohort: DataFrame, chart: DataFrame, max_hours: int = 72, items: Mapping[int, str] = vocab.CHART_ITEMS, **hot
) -> DataFrame:
    """Hourly medians of charted items, pivoted and merged to the channel set.

    Arterial pressures win over cuff readings, Celsius over converted Fahrenheit;
    the coma total exists only with all three parts.
    """
    log = chart.where(F.col("itemid").isin(list(items))).select("stay_id", "charttime", "itemid", "valuenum", "value")
    starts = cohort.select("stay_id", "subject_id", "intime")
    rows = with_hour(log, starts, "stay_id", "charttime", "intime", max_hours)
    keys = ["subject_id", "stay_id", "hour"]
    wide = hourly_medians(rows, keys, "itemid", items, number_or_leading_digits("valuenum", "value"), **hot)
    return wide.select(
        *keys,
        "hr",
        F.coalesce("sbp_art", "sbp_ni").alias("sbp"),
        F.coalesce("dbp_art", "dbp_ni").alias("dbp"),
        F.coalesce("map_art", "map_ni").alias("map"),
        "rr",
        "spo2",
        F.coalesce(F.col("temp_c_direct"), fahrenheit_to_celsius("temp_f")).alias("temp_c"),
        "gcs_eye",
        "gcs_verbal",
        "gcs_motor",
        strict_sum("gcs_eye", "gcs_verbal", "gcs_motor").alias("gcs_total"),
    )


def extract_freetext_cohort(
    tables: Mapping[str, DataFrame],
    min_los_hours: float = 6,
    max_los_days: float = 30,
    terms: Sequence[str] = vocab.FREETEXT_TERMS,
    ladder: Sequence[tuple] = vocab.FREETEXT_SUBTYPES,
    source_label: str = "external",
) -> DataFrame:
    """Cohort of a source with free-text diagnoses, in the coded cohort's names.

    ``tables``: patient, diagnosis, outcome, gcs. First stay per person; ties go
    to the lowest stay id, then the earliest diagnosis.
    """
    require(tables, {"patient": ["patientunitstayid", "age"], "diagnosis": ["patientunitstayid", "diagnosisstring"]})
    age = parse_with_sentinel("age")
    minutes = F.col("unitdischargeoffset") - F.col("unitadmitoffset")
    patients = (
        tables["patient"].withColumns({"age": age, "unitadmitoffset": F.lit(0)})
        .where(F.col("age") >= 18)
        .where((minutes >= min_los_hours * 60) & (minutes <= max_los_days * 1440))
        .withColumn("los", round_scaled(minutes / F.lit(1440.0), 2))
        .select(
            "patientunitstayid", "patienthealthsystemstayid", "gender", "age", "ethnicity", "hospitalid", "unittype",
            "unitadmitoffset", "unitdischargeoffset", "hospitaldischargestatus", "los",
        )
    )
    # one diagnosis per stay is enough to rank the stays of a person
    dx = first_record(
        tables["diagnosis"].where(text_match("diagnosisstring", terms))
        .select("patientunitstayid", "diagnosisoffset", "diagnosisstring", "icd9code"),
        "patientunitstayid", "diagnosisoffset", ["diagnosisstring", "icd9code"],
    ).withColumn("stroke_subtype", text_ladder("diagnosisstring", ladder, "other"))
    first = first_record(
        patients.join(dx, "patientunitstayid"), "patienthealthsystemstayid", "unitadmitoffset", ["patientunitstayid"]
    ).drop("diagnosisoffset")
    outcome = best_record(
        tables["outcome"].select("patientunitstayid", "actualhospitalmortality", "apachescore"),
        "patientunitstayid", "apachescore", ["actualhospitalmortality"],
    )
    gcs = first_record(
        tables["gcs"].select(
            "patientunitstayid", F.col("eyes").alias("gcs_eye"), F.col("motor").alias("gcs_motor"),
            F.col("verbal").alias("gcs_verbal"),
        ),
        "patientunitstayid", "gcs_eye", ["gcs_motor", "gcs_verbal"],
    ).withColumn("gcs_total", strict_sum("gcs_eye", "gcs_motor", "gcs_verbal"))
    out = star_join(first, ["patientunitstayid"], outcome, gcs).withColumn(
        "hospital_expire_flag", flag_equals("actualhospitalmortality", "expired")
    )
    return harmonise(out, source_label)


def harmonise(df: DataFrame, source_label: str, names: Mapping[str, str] = vocab.HARMONISED_NAMES) -> DataFrame:
    """Common column names, gender letters and a provenance column."""
    out = df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
    if "gender" in out.columns:
        out = out.withColumn("gender", map_values("gender", vocab.GENDER_VALUES))
    if "hospital_expire_flag" in out.columns:
        out = out.withColumn("hospital_expire_flag", F.col("hospital_expire_flag").cast("int"))
    return out.withColumn("data_source", F.lit(source_label))


# --- fixed values: wide vital columns and their channels ---
PERIODIC_CHANNELS = {
    "heartrate": "hr", "systemicsystolic": "sbp", "systemicdiastolic": "dbp", "systemicmean": "map",
    "respiration": "rr", "sao2": "spo2", "temperature": "temp_c",
}


def extract_periodic_timeseries(
    cohort: DataFrame, vitals: DataFrame, gcs: DataFrame, max_hours: int = 72, **hot
) -> DataFrame:
    """Hourly medians of wide vitals with one coma score per stay on every hour.

    An empty cohort gives an empty frame of the same type, with no special case.
    """
    ids = cohort.select(F.col("hadm_id").alias("patientunitstayid"), "subject_id")
    hour = hour_of_offset("observationoffset")
    rows = (
        restrict_to(vitals.where((F.col("observationoffset") >= 0) & (hour <= max_hours)), ids, ["patientunitstayid"])
        .select("patientunitstayid", hour.alias("hour"), *PERIODIC_CHANNELS)
    )
    wide = hourly_column_medians(rows, ["patientunitstayid", "hour"], PERIODIC_CHANNELS, **hot)
    wide = wide.withColumn("temp_c", celsius_guarded("temp_c"))
    score = gcs.select(
        "patientunitstayid", F.col("eyes").alias("gcs_eye"), F.col("motor").alias("gcs_motor"),
        F.col("verbal").alias("gcs_verbal"), strict_sum("eyes", "motor", "verbal").alias("gcs_total"),
    )
    ts = wide.join(score, "patientunitstayid", "left")
    ts = key_map(ts, ids, "patientunitstayid", "subject_id").withColumnRenamed("patientunitstayid", "stay_id")
    schema = {"subject_id": "long", "stay_id": "long", "hour": "int"} | dict.fromkeys(vocab.CHANNELS, "double")
    return conform(ts, schema)
