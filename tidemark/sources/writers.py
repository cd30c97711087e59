"""Sinks: Parquet stages, CSV result tables, parameters and metrics as JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Overwrite a Parquet stage and return it as read back."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_result_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> DataFrame:
    """CSV parts of a result table of any size, and their manifest.

    With ``order`` the rows are sorted by range over all tasks, NULL first: each part is sorted and follows the one before. The
    manifest (part, file, rows), returned and kept as JSON under ``<path>.manifest``, lists the parts in that order.
    """
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").option("header", True).csv(path)
    spark = df.sparkSession
    rows = spark.read.schema(_as_text(df)).option("header", True).csv(path).groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    name = F.element_at(F.split("file", "/"), -1)
    manifest = rows.select(F.regexp_extract(name, "part-([0-9]+)", 1).cast("int").alias("part"), name.alias("file"), "rows")
    manifest.orderBy("part").write.mode("overwrite").json(f"{path}.manifest")
    return spark.read.schema("part int, file string, rows long").json(f"{path}.manifest")


def _as_text(df: DataFrame) -> str:
    return ", ".join(f"`{c}` string" for c in df.columns)


def params_frame(spark: SparkSession, params: Mapping[str, Mapping[str, float]]) -> DataFrame:
    return spark.createDataFrame(
        [(c, float(p["min"]), float(p["max"])) for c, p in params.items()], "column string, min double, max double"
    )


def save_params(spark: SparkSession, params: Mapping[str, Mapping[str, float]], path: str) -> None:
    params_frame(spark, params).write.mode("overwrite").json(path)


def load_params(spark: SparkSession, path: str) -> dict[str, dict[str, float]]:
    rows = spark.read.schema("column string, min double, max double").json(path).collect()
    return {r["column"]: {"min": r["min"], "max": r["max"]} for r in rows}


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Long metric table as JSON lines; non-finite values become NULL."""
    out = metrics
    for c, t in metrics.dtypes:
        if t == "double":
            bad = F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf")))
            out = out.withColumn(c, F.when(~bad, F.col(c)))
    out.write.mode("overwrite").json(path)


def run_sql(spark: SparkSession, text: str, tables: Mapping[str, DataFrame], **args) -> DataFrame:
    """Parameterised query text over named tables: ``:name`` markers for values,
    ``{table}`` for tables; no string pasting of values."""
    return spark.sql(text, args=args or None, **tables)
