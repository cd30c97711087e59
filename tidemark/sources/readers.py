"""Readers with explicit schemas, and the one-time landing of gzipped text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

LONG, INT, DOUBLE, TEXT, TIME, DATE = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampType(), T.DateType()


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# --- fixed values: source table layouts ---
SCHEMAS: dict[str, T.StructType] = {
    "diagnoses": _table(subject_id=LONG, hadm_id=LONG, seq_num=INT, icd_code=TEXT, icd_version=INT),
    "dictionary": _table(icd_code=TEXT, icd_version=INT, long_title=TEXT),
    "stays": _table(
        subject_id=LONG, hadm_id=LONG, stay_id=LONG, first_careunit=TEXT, last_careunit=TEXT, intime=TIME, outtime=TIME, los=DOUBLE
    ),
    "patients": _table(subject_id=LONG, gender=TEXT, anchor_age=INT, anchor_year=INT, anchor_year_group=TEXT, dod=DATE),
    "admissions": _table(
        subject_id=LONG, hadm_id=LONG, admittime=TIME, dischtime=TIME, deathtime=TIME, admission_type=TEXT, admit_provider_id=TEXT,
        admission_location=TEXT, discharge_location=TEXT, insurance=TEXT, language=TEXT, marital_status=TEXT, race=TEXT,
        edregtime=TIME, edouttime=TIME, hospital_expire_flag=INT,
    ),
}


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Text with a header line; gzip is recognised by name. Types are given, not
    inferred: inference would read everything twice. Columns go by name."""
    names = spark.read.option("header", True).csv(path).columns  # header line only
    known = {f.name: f for f in schema.fields}
    full = T.StructType([known.get(n, T.StructField(n, T.StringType())) for n in names])
    df = spark.read.schema(full).option("header", True).option("enforceSchema", False).csv(path)
    missing = [n for n in known if n not in names]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    return df.select(*known)


def land(spark: SparkSession, path: str, schema: T.StructType, target: str, key: str | None = None, parts: int | None = None) -> DataFrame:
    """Read gzipped text once and keep it as Parquet.

    A gzip file is one task whatever its size, so rows are spread at once;
    with ``key`` they are also clustered, which prunes later joins on it.
    """
    df = read_csv(spark, path, schema)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartition(n, key) if key else df.repartition(n)
    spread.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def require(tables: Mapping[str, DataFrame], needed: Mapping[str, Iterable[str]]) -> None:
    """Stop before any job when a table or column is missing."""
    for name, cols in needed.items():
        if name not in tables:
            raise FileNotFoundError(f"missing required table: {name}")
        lacking = [c for c in cols if c not in tables[name].columns]
        if lacking:
            raise ValueError(f"table {name} lacks columns {lacking}")


def require_paths(spark: SparkSession, paths: Iterable[str]) -> None:
    """Stop early when an input path does not exist on its file system."""
    for p in paths:
        try:
            spark.read.format("binaryFile").load(p).schema
        except Exception as e:
            raise FileNotFoundError(f"missing required input: {p}") from e
