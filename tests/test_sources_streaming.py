"""Readers, writers, and streams against their batch forms."""

import gzip

import pytest
from pyspark.sql import functions as F

from tidemark.catalog import feedback_queries as fq
from tidemark.catalog.registry import rounded, table
from tidemark.operators import twin
from tidemark.plans.cohort_jobs import extract_cohort, extract_periodic_timeseries
from tidemark.plans.external_validation import validate_externally
from tidemark.plans.report import cohort_report
from tidemark.sources import readers, writers
from tidemark.streaming import run, twin_stream


def test_gzip_csv_landing(spark, tmp_path):
    path = f"{tmp_path}/d.csv.gz"
    with gzip.open(path, "wt") as f:
        f.write("icd_version,icd_code,long_title\n9,0430,\"a, b\"\n10,I63,c\n")
    df = readers.land(spark, path, readers.SCHEMAS["dictionary"], f"{tmp_path}/out", "icd_code", 2)
    assert sorted(map(tuple, df.collect())) == [("0430", 9, "a, b"), ("I63", 10, "c")]
    with pytest.raises(ValueError):
        readers.read_csv(spark, path, readers.SCHEMAS["patients"])


def test_requirements(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.require({}, {"patient": ["a"]})
    with pytest.raises(ValueError):
        readers.require({"patient": spark.range(1)}, {"patient": ["a"]})
    with pytest.raises(FileNotFoundError):
        readers.require_paths(spark, [f"{tmp_path}/nothing.csv.gz"])


def test_params_and_metrics_round_trip(spark, tmp_path):
    params = {"age": {"min": 18.0, "max": 99.5}, "x y": {"min": -1.0, "max": 1.0}}
    writers.save_params(spark, params, f"{tmp_path}/p")
    assert writers.load_params(spark, f"{tmp_path}/p") == params
    m = spark.createDataFrame([("a", float("nan")), ("b", 2.0)], "metric string, value double")
    writers.write_metrics(m, f"{tmp_path}/m")
    assert {r["metric"]: r["value"] for r in spark.read.schema("metric string, value double").json(f"{tmp_path}/m").collect()} == {"a": None, "b": 2.0}
    writers.write_result_csv(m, f"{tmp_path}/c", ["metric"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").columns == ["metric", "value"]


def test_cohort_is_one_row_per_subject(spark, folder):
    from tidemark.catalog.clinical import coded_tables

    c = extract_cohort(coded_tables(spark, folder))
    n = c.count()
    assert n > 0 and n == c.select("subject_id").distinct().count()
    assert c.where("los < 0.25 OR los > 30").count() == 0


def test_empty_cohort_gives_empty_typed_series(spark, folder):
    from tidemark.catalog.clinical import freetext_tables

    t = freetext_tables(spark, folder)
    none = spark.createDataFrame([], "hadm_id long, subject_id long")
    out = extract_periodic_timeseries(none, t["vitals"], t["gcs"])
    assert out.count() == 0 and dict(out.dtypes)["gcs_total"] == "double"


def test_external_validation_run(spark, folder, tmp_path):
    from tidemark.catalog.clinical import freetext_tables, static_features

    out = validate_externally(freetext_tables(spark, folder), str(tmp_path), static_features(spark, folder))
    assert set(out) == {"cohort", "timeseries", "comparison"}
    rows = {r["metric"]: r for r in out["comparison"].collect()}
    assert rows["pct_male"]["p_value"] is not None and rows["n_patients"]["p_value"] is None


def test_report_tables(spark, folder):
    from tidemark.catalog.clinical import static_features
    from tidemark.session import cut_lineage

    static = cut_lineage(static_features(spark, folder))
    series = static.select("stay_id").crossJoin(spark.range(3).withColumnRenamed("id", "hour")).withColumns(
        {"gcs_total": F.lit(10.0), "hr": F.col("hour") * 1.0, "sbp": F.lit(None).cast("double")}
    )
    tables = cohort_report(static, series)
    assert len(tables) >= 15
    by = tables["table1_by_mortality"].toPandas().set_index("variable")
    assert by.loc["Stroke subtype — Ischemic", "p_value"] is not None
    assert tables["gcs_by_subtype"].count() > 0


LATE = "31 days"


@pytest.fixture(scope="module")
def many_files(spark, folder, tmp_path_factory):
    """The event table as several files that mix all times, so that windows and orders span micro-batches."""
    out = str(tmp_path_factory.mktemp("events"))
    spark.read.parquet(f"{folder}/events.parquet").repartition(4, "event_id").write.mode("append").parquet(out)
    return out


def _stream(spark, path):
    s = run.file_stream(spark, path, "*.parquet", files_per_trigger=1)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _drift(spark, path, base=None):
    blocks = twin_stream.ema_blocks(fq.feedback(_stream(spark, path)), tie="feedback_id", watermark=LATE)
    updates = run.run_available(blocks, "update", base)
    got = twin_stream.drift_of_blocks(run.latest(updates, "entity_id", "block_start")).collect()
    return updates, {r["entity_id"]: (r["recent_drift"], r["n_feedback"]) for r in got}


def _batch_drift(spark, folder):
    rows = twin.ema_drift(fq.feedback(table(spark, folder, "events")), ties=["feedback_id"]).collect()
    return {r["entity_id"]: (r["recent_drift"], r["n_feedback"]) for r in rows}


def test_streamed_drift_equals_batch(spark, folder, many_files):
    updates, got = _drift(spark, many_files)
    assert updates.select("epoch").distinct().count() == 4
    want = _batch_drift(spark, folder)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_drift_of_one_entity_by_hand(spark, tmp_path):
    """First record empty, then 4 and 8 in one block and 2 in the next: no warm start."""
    rows = [(1, f"2024-01-01 {t}", e) for t, e in [("00:00", None), ("00:10", 4.0), ("00:50", 8.0), ("03:00", 2.0)]]
    errs = F.when(F.col("e").isNull(), F.create_map().cast("map<string,double>")).otherwise(F.create_map(F.lit("x"), F.col("e")))
    src = spark.createDataFrame(rows, "entity_id int, t string, e double").select("entity_id", F.to_timestamp("t").alias("ts"), errs.alias("error"))
    for row in range(4):  # arrives from last to first
        src.orderBy(F.desc("ts")).offset(row).limit(1).coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")
    s = run.file_stream(spark, f"{tmp_path}/src", "*.parquet", files_per_trigger=1)
    out = run.run_available(twin_stream.ema_blocks(s, watermark="1 day"), "update")
    got = twin_stream.drift_of_blocks(run.latest(out, "entity_id", "block_start"), threshold=1.0).first()
    want = 0.3 * 2 + 0.7 * (0.3 * 8 + 0.7 * (0.3 * 4))
    assert got["recent_drift"] == pytest.approx(want) and got["n_feedback"] == 4 and got["needs_recalibration"]


def test_streamed_join_equals_batch(spark, folder, many_files):
    p = twin_stream.log_predictions(fq.predictions(_stream(spark, many_files)))
    j = twin_stream.pair_feedback(p, fq.actuals(_stream(spark, many_files)), watermark=LATE)
    out = run.run_available(j.select("view_id", "click_id", F.col("error")["value"].alias("e"))).drop("epoch")
    ev = table(spark, folder, "events")
    batch = twin.pair_feedback(fq.predictions(ev), fq.actuals(ev)).where("actual_ts >= ts AND actual_ts <= ts + INTERVAL 1 HOUR")
    want = rounded(batch.select("view_id", "click_id", F.col("error")["value"].alias("e")))
    got = sorted(map(tuple, rounded(out).collect()))
    assert got == sorted(map(tuple, want.collect())) and got
    assert len({c for _, c, _ in got}) == len(got)  # one row per actual


def test_streamed_medians_leave_no_window_out(spark, folder, many_files):
    keys = ["event_type"]
    counts = run.run_available(twin_stream.value_counts(_stream(spark, many_files), "ts", keys, "value", "1 day", LATE), "update")
    med = twin_stream.medians_of_counts(run.latest(counts, "window_start", *keys, "value"), keys)
    want = table(spark, folder, "events").groupBy(F.date_trunc("day", "ts").alias("w"), "event_type").agg(F.median("value"), F.count(F.lit(1)))
    got = rounded(med.select("window_start", "event_type", "median_value", "n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rounded(want).collect()))


def test_prediction_ids_are_stable(spark):
    df = spark.createDataFrame([(1, 5, {"x": 1.0})], "entity_id int, ts int, predicted map<string,double>")
    a, b = (twin_stream.log_predictions(df).first()["prediction_id"] for _ in range(2))
    assert a == b and len(a) == 64


def test_empty_feedback_reports_zeros(spark):
    fb = spark.createDataFrame([], "entity_id int, ts timestamp, error map<string,double>")
    r = twin.drift_report(fb, spark.createDataFrame([(7,)], "entity_id int")).first()
    assert tuple(r) == (7, 0.0, 0.0, {}, False, 0)


def test_drift_state_survives_a_restart(spark, folder, tmp_path):
    """Two runs on the same progress folder give what one batch over everything gives."""
    ev = spark.read.parquet(f"{folder}/events.parquet")
    src, base = f"{tmp_path}/src", f"{tmp_path}/query"
    cut = F.col("ts") < "2024-01-14"
    for part in (ev.where(~cut), ev.where(cut)):  # the later half first
        part.coalesce(1).write.mode("append").parquet(src)
        _, got = _drift(spark, src, base)
    want = _batch_drift(spark, folder)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_empty_stream_gives_empty_rows(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/events.parquet").where("event_id < 0").coalesce(1).write.parquet(f"{tmp_path}/src")
    counts = run.run_available(twin_stream.value_counts(_stream(spark, f"{tmp_path}/src"), "ts", ["user_id"], "value"), "update")
    assert counts.count() == 0 and "value" in counts.columns


def test_ordered_result_in_parts(spark, tmp_path):
    """Parts in the order of the manifest, one after another, are the sorted table."""
    path = f"{tmp_path}/result"
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = writers.write_result_csv(df, path, ["k"]).orderBy("part").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(manifest) > 1 and sum(r["rows"] for r in manifest) == 5000
    lines = [line.split(",") for r in manifest for line in open(f"{path}/{r['file']}").read().splitlines()[1:]]
    assert [int(k) for k, _ in lines] == list(range(5000))
    assert sum(v == "" or v == '""' for _, v in lines) == df.where("v IS NULL").count()
    empty = writers.write_result_csv(df.where("false"), f"{tmp_path}/none", ["k"])
    assert empty.agg(F.sum("rows")).first()[0] in (None, 0)
