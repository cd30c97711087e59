"""Whole jobs and the sources and sinks they use."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import vocab
from tidemark.catalog.clinical import coded_tables, freetext_tables, static_features
from tidemark.catalog.preparation import u_sql
from tidemark.catalog.registry import query, r, rounded, table
from tidemark.catalog.statistics import COHORT_TESTS_SQL
from tidemark.operators.bayes import fit_network
from tidemark.operators.prep import apply_minmax, fit_minmax
from tidemark.plans.external_validation import validate_externally
from tidemark.plans.generation import generate_complete
from tidemark.plans.preprocessing import splits_or_new
from tidemark.plans.report import cohort_report, write_report
from tidemark.session import checkpoint_folder, cut_lineage
from tidemark.sources import readers, writers


def _place(spark, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("gzip_csv_landing", f"SELECT o_orderkey, o_custkey, o_orderstatus, {r('o_totalprice')} AS o_totalprice, o_orderdate, o_orderpriority FROM orders")
def gzip_csv_landing(spark, folder):
    """The order table through gzipped text with a header, explicit types and Parquet."""
    base = _place(spark, "landing")
    orders = table(spark, folder, "orders")
    orders.write.option("header", True).option("compression", "gzip").csv(f"{base}/text")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in orders.schema.fields])
    return rounded(readers.land(spark, f"{base}/text", schema, f"{base}/table", "o_orderkey"))


@query(
    "params_round_trip",
    f"""SELECT c_custkey, {r("2 * (c_acctbal - lo) / (hi - lo) - 1")} AS c_acctbal FROM customer, (SELECT MIN(c_acctbal) AS lo, MAX(c_acctbal) AS hi FROM customer)""",
)
def params_round_trip(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    path = _place(spark, "params")
    writers.save_params(spark, fit_minmax(c, ["c_acctbal"]), path)
    return rounded(apply_minmax(c, writers.load_params(spark, path)))


@query(
    "metrics_round_trip",
    f"""SELECT event_type AS model, 'mean_value' AS metric, {r("AVG(value)")} AS value FROM events GROUP BY event_type
    UNION ALL SELECT event_type, 'undefined', NULL FROM events GROUP BY event_type""",
)
def metrics_round_trip(spark, folder):
    m = table(spark, folder, "events").groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("v"))
    long = m.select("model", F.explode(F.array(
        F.struct(F.lit("mean_value").alias("metric"), F.col("v").alias("value")),
        F.struct(F.lit("undefined").alias("metric"), F.lit(float("inf")).alias("value")))).alias("e")).select("model", "e.*")
    path = _place(spark, "metrics")
    writers.write_metrics(long, path)
    return rounded(spark.read.schema("model string, metric string, value double").json(path))


@query(
    "stored_splits",
    f"""SELECT doc_id, quality, CASE WHEN rn <= round(n * 0.2) THEN 'test' ELSE 'train' END AS part
    FROM (SELECT doc_id, quality, ROW_NUMBER() OVER (PARTITION BY quality ORDER BY {u_sql("42", "doc_id")}, doc_id) AS rn, COUNT(*) OVER (PARTITION BY quality) AS n FROM labels)""",
)
def stored_splits(spark, folder):
    """A new split is stored; the next run takes the stored one."""
    lab, path = table(spark, folder, "labels").select("doc_id", "quality"), _place(spark, "splits")
    new = splits_or_new(lab, None, ["doc_id"], "quality")
    stored = {name: writers.write_stage(df, f"{path}/{name}") for name, df in zip(("train", "test"), new)}
    train, test = splits_or_new(lab.where("false"), stored, ["doc_id"], "quality")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "ordered_result",
    "SELECT o_orderkey, o_totalprice, ROW_NUMBER() OVER (ORDER BY o_totalprice, o_orderkey) AS position FROM orders",
)
def ordered_result(spark, folder):
    """Orders written as sorted CSV parts; a row's position follows from the manifest and its place in its part."""
    order, path = ["o_totalprice", "o_orderkey"], _place(spark, "ordered")
    manifest = writers.write_result_csv(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), path, order)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    starts = manifest.select("file", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    rows = spark.read.schema("o_orderkey long, o_totalprice double").option("header", True).csv(path)
    rows = rows.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).join(starts, "file")
    return rows.select("o_orderkey", "o_totalprice", (F.row_number().over(Window.partitionBy("file").orderBy(*order)) + F.col("start")).alias("position"))


@query("report_tables")
def report_tables(spark, folder):
    """All report tables, written as CSV and read back as (table, line)."""
    static = cut_lineage(static_features(spark, folder))
    path = _place(spark, "report")
    tables = cohort_report(static)
    write_report(tables, path)
    return spark.read.text(f"{path}/*.csv/part-*").select(
        F.regexp_extract(F.input_file_name(), r"/([a-z0-9_]+)\.csv/", 1).alias("table"), F.col("value").alias("line")
    )


@query("external_validation", COHORT_TESTS_SQL)
def external_validation(spark, folder):
    primary = cut_lineage(static_features(spark, folder))
    return validate_externally(freetext_tables(spark, folder), _place(spark, "external"), primary)["comparison"]


@query("complete_generation")
def complete_generation(spark, folder):
    """Synthetic stays with the laboratory series of matched donors."""
    keep = ["stay_id", *vocab.PROFILE_FEATURES]
    static = cut_lineage(static_features(spark, folder).select(*keep))
    labs = coded_tables(spark, folder)["labs"].where("valuenum IS NOT NULL")
    series = labs.groupBy(F.col("hadm_id").alias("stay_id"), F.hour("charttime").alias("hour")).agg(F.avg("valuenum").alias("level"))
    net = fit_network(static, keep[1:])
    profiles, ts = generate_complete(net, static.count(), static, series, ["stroke_subtype", "gender"])
    return rounded(ts.join(profiles, ["dataset_id", "row_id"]))
