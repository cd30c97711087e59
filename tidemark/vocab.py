"""Clinical vocabularies, ranges and bins used as defaults.

Every operator takes them as arguments; nothing here is hard-wired.
"""

# --- fixed values: qualifying diagnosis code prefixes by code version ---
COHORT_PREFIXES = {
    9: ["430", "431", "432", "433", "434", "435"],
    10: ["I60", "I61", "I62", "I63", "I64", "I65", "I66", "I67", "G45"],
}
COHORT_EXACT = {9: ["436"]}

# --- fixed values: comorbidity flags, prefixes by code version ---
COMORBIDITY_PREFIXES = {
    "has_hypertension": {9: ["401"], 10: ["I10"]},
    "has_diabetes": {9: ["250"], 10: ["E11"]},
    "has_afib": {9: ["4273"], 10: ["I48"]},
    "has_dyslipidemia": {9: ["272"], 10: ["E78"]},
    "has_ckd": {9: ["585"], 10: ["N18"]},
    "has_cad": {9: ["410", "412"], 10: ["I21", "I25"]},
}

# --- fixed values: subtype ladder, first match wins; version None = any ---
SUBTYPE_LADDER = [
    ("I63", None, "ischemic"),
    ("I61", None, "ich"),
    ("I62", None, "ich"),
    ("I60", None, "sah"),
    ("I64", None, "other"),
    ("G45", None, "tia"),
    ("433", 9, "ischemic"),
    ("434", 9, "ischemic"),
    ("430", 9, "sah"),
    ("431", 9, "ich"),
    ("432", 9, "ich"),
    ("435", 9, "tia"),
]
SUBTYPES = ["ischemic", "ich", "sah", "tia", "other"]

# --- fixed values: free-text cohort terms and subtype terms ---
FREETEXT_TERMS = [
    "stroke",
    "cerebrovascular accident",
    " cva ",
    " cva,",
    "cerebral infarction",
    "ischemic stroke",
    "intracerebral hemorrhage",
    "intracranial hemorrhage",
    "subarachnoid hemorrhage",
    "transient ischemic",
    "cerebral embolism",
    "cerebral thrombosis",
    "brain infarction",
]
FREETEXT_SUBTYPES = [
    ("sah", ["subarachnoid hemorrhage"]),
    ("ich", ["intracerebral hemorrhage", "intracranial hemorrhage"]),
    ("tia", ["transient ischemic"]),
    ("ischemic", ["ischemic", "infarction", "thrombosis", "embolism"]),
]

# --- fixed values: laboratory item ids ---
LAB_ITEMS = {
    50931: "lab_glucose",
    50983: "lab_sodium",
    50912: "lab_creatinine",
    51222: "lab_hemoglobin",
    51265: "lab_platelets",
    51237: "lab_inr",
}
LAB_COLUMNS = list(LAB_ITEMS.values())

# --- fixed values: charted item ids ---
CHART_ITEMS = {
    220045: "hr",
    220050: "sbp_art",
    220051: "dbp_art",
    220052: "map_art",
    220179: "sbp_ni",
    220180: "dbp_ni",
    220181: "map_ni",
    220210: "rr",
    220277: "spo2",
    223762: "temp_c_direct",
    223761: "temp_f",
    220739: "gcs_eye",
    223900: "gcs_verbal",
    223901: "gcs_motor",
}

# --- fixed values: output channels and their physiological clip ranges ---
CLIP_RANGES = {
    "hr": (20, 300),
    "sbp": (40, 300),
    "dbp": (20, 200),
    "map": (20, 250),
    "rr": (4, 60),
    "spo2": (50, 100),
    "temp_c": (30, 45),
    "gcs_eye": (1, 4),
    "gcs_verbal": (1, 5),
    "gcs_motor": (1, 6),
    "gcs_total": (3, 15),
}
CHANNELS = list(CLIP_RANGES)

# --- fixed values: plausibility rules as SQL predicates with their columns ---
PLAUSIBILITY_RULES = {
    "age_valid": (["anchor_age"], "anchor_age >= 18 AND anchor_age <= 120"),
    "gcs_valid": (["gcs_total"], "gcs_total >= 3 AND gcs_total <= 15"),
    "los_positive": (["los"], "los > 0"),
    "sbp_gt_dbp": (["sbp", "dbp"], "sbp > dbp"),
    "spo2_range": (["spo2"], "spo2 >= 50 AND spo2 <= 100"),
    "hr_range": (["hr"], "hr >= 20 AND hr <= 300"),
    "temp_range": (["temp_c"], "temp_c >= 30 AND temp_c <= 45"),
}

# --- fixed values: profile-network features, bins, labels, inverse ranges ---
PROFILE_FEATURES = [
    "anchor_age", "gender", "stroke_subtype", "hospital_expire_flag", "los",
    "has_hypertension", "has_diabetes", "has_afib", "has_dyslipidemia", "has_ckd", "has_cad",
    "lab_glucose", "lab_sodium", "lab_creatinine", "lab_hemoglobin", "lab_platelets", "lab_inr",
]
FIXED_BINS = {
    "anchor_age": (
        [0, 45, 55, 65, 75, 85, 200],
        ["18-45", "45-55", "55-65", "65-75", "75-85", "85+"],
    ),
    "los": ([0, 1, 3, 7, 14, 1e6], ["0-1d", "1-3d", "3-7d", "7-14d", "14+d"]),
}
INVERSE_RANGES = {
    "anchor_age": {
        "18-45": (18, 45), "45-55": (45, 55), "55-65": (55, 65),
        "65-75": (65, 75), "75-85": (75, 85), "85+": (85, 100),
    },
    "los": {"0-1d": (0, 1), "1-3d": (1, 3), "3-7d": (3, 7), "7-14d": (7, 14), "14+d": (14, 30)},
}
INVERSE_DEFAULTS = {"anchor_age": (65, 75), "los": (3, 7)}

# --- fixed values: conditioning attributes, categorical and id columns ---
METADATA_COLUMNS = [
    "anchor_age", "los", "hospital_expire_flag",
    "has_hypertension", "has_diabetes", "has_afib", "has_dyslipidemia", "has_ckd", "has_cad",
]
CATEGORICAL_COLUMNS = [
    "gender", "race", "insurance", "stroke_subtype", "first_careunit", "admission_type",
]
ID_COLUMNS = ["subject_id", "hadm_id", "stay_id"]
NON_MODEL_COLUMNS = [
    "icd_code", "icd_version", "seq_num", "icd_title", "intime", "outtime", "dod",
    "admittime", "dischtime", "deathtime", "admission_location", "discharge_location",
]

# --- fixed values: report labels and laboratory normal ranges ---
COMORBIDITY_LABELS = {
    "has_hypertension": "Hypertension",
    "has_diabetes": "Diabetes",
    "has_afib": "Atrial Fibrillation",
    "has_dyslipidemia": "Dyslipidemia",
    "has_ckd": "CKD",
    "has_cad": "CAD",
}
LAB_LABELS = {
    "lab_glucose": "Glucose (mg/dL)",
    "lab_sodium": "Sodium (mEq/L)",
    "lab_creatinine": "Creatinine (mg/dL)",
    "lab_hemoglobin": "Hemoglobin (g/dL)",
    "lab_platelets": "Platelets (10³/µL)",
    "lab_inr": "INR",
}
LAB_NORMAL_RANGES = {
    "lab_glucose": (70, 100),
    "lab_sodium": (136, 145),
    "lab_creatinine": (0.7, 1.3),
    "lab_hemoglobin": (12.0, 17.5),
    "lab_platelets": (150, 400),
    "lab_inr": (0.8, 1.1),
}
SUBTYPE_LABELS = {"ischemic": "Ischemic", "ich": "ICH", "sah": "SAH", "tia": "TIA", "other": "Other"}
AGE_GROUPS = ([0, 50, 65, 80, 200], ["<50", "50-64", "65-79", "80+"])

# --- fixed values: harmonised names and values of the free-text source ---
HARMONISED_NAMES = {
    "patienthealthsystemstayid": "subject_id",
    "patientunitstayid": "hadm_id",
    "age": "anchor_age",
    "hospitaldischargestatus": "discharge_status",
    "actualhospitalmortality": "mortality_label",
    "ethnicity": "race",
}
GENDER_VALUES = {"Male": "M", "Female": "F", "male": "M", "female": "F"}
