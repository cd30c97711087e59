"""Closed-form preparation fixtures."""

import pytest
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions import exprs
from tidemark.operators import prep, timeseries
from tidemark.plans.preprocessing import preprocess, preprocess_series, splits_or_new, write_prepared


def test_one_hot(spark):
    df = spark.createDataFrame([("M", "ischemic", "Medicare"), ("F", "ich", "Medicaid"), ("M", "sah", "Other")], ["gender", "stroke_subtype", "insurance"])
    out = prep.one_hot(df, prep.fit_categories(df))
    assert out.count() == 3 and "gender_M" in out.columns and "gender" not in out.columns
    assert [r["gender_M"] for r in out.collect()] == [1, 0, 1]


def test_impute_median(spark):
    df = spark.createDataFrame([(65, 120.0, 1), (None, None, 0), (70, None, 1)], "anchor_age int, glucose_admit double, has_hypertension int")
    out = prep.impute(df)
    assert "glucose_admit_missing" in out.columns
    assert out.where(F.greatest(*[F.col(c).isNull().cast("int") for c in out.columns]) == 1).count() == 0
    assert [r["anchor_age"] for r in out.collect()] == [65, 67.5, 70]


def test_impute_mean_and_bad_method(spark):
    df = spark.createDataFrame([(60, 100.0), (None, None), (80, 200.0)], "anchor_age int, lab_glucose double")
    out = prep.impute(df, "mean").collect()
    assert out[1]["anchor_age"] == 70 and out[1]["lab_glucose"] == 150 and out[1]["lab_glucose_missing"] == 1
    with pytest.raises(ValueError):
        prep.impute(df, "mode")


def test_impute_mode_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("a",)], "c string")
    assert prep.modes(df, ["c"]) == {"c": "a"}


def test_minmax_range_and_inverse(spark):
    df = spark.createDataFrame([(20, 1.0, 5.0), (40, 2.0, 5.0), (60, 3.0, 5.0), (80, 4.0, 5.0)], "anchor_age int, los double, flat double")
    fit = prep.fit_minmax(df, ["anchor_age", "los", "flat"])
    out = prep.apply_minmax(df, fit)
    row = out.agg(F.min("anchor_age"), F.max("anchor_age"), F.min("los"), F.max("los"), F.min("flat")).first()
    assert tuple(row) == (-1.0, 1.0, -1.0, 1.0, 5.0)
    back = prep.invert_minmax(out, fit)
    assert [r["anchor_age"] for r in back.collect()] == pytest.approx([20, 40, 60, 80])
    three = spark.createDataFrame([(-1.0,), (0.0,), (1.0,)], "age double")
    got = prep.invert_minmax(three, {"age": {"min": 18, "max": 100}}).collect()
    assert [r["age"] for r in got] == [18, 59, 100]


def test_split_sizes_and_strata(spark):
    df = spark.range(100).withColumn("flag", (F.col("id") >= 85).cast("int"))
    out = prep.stratified_split(df, ["id"], "flag", 0.2, 0.1)
    sizes = {r["split"]: (r["n"], r["share"]) for r in out.groupBy("split").agg(F.count("*").alias("n"), F.avg("flag").alias("share")).collect()}
    assert sum(n for n, _ in sizes.values()) == 100
    assert sizes["test"][0] == 20 and abs(sizes["train"][1] - 0.15) <= 0.05
    assert out.select("id").distinct().count() == 100


def test_stored_splits_win(spark):
    df = spark.range(10).withColumn("flag", F.lit(1))
    assert splits_or_new(df, {"train": df, "test": df}, ["id"], "flag") == (df, df)
    train, test = splits_or_new(df, None, ["id"], "flag")
    assert (train.count(), test.count()) == (8, 2)


def test_series_fill_and_clip(spark):
    rows = [(100, 0, 80.0, 98.0), (100, 1, None, 97.0), (100, 2, None, None), (100, 3, 85.0, None), (100, 4, None, 96.0), (100, 5, 999.0, 10.0)]
    df = spark.createDataFrame(rows, "stay_id int, hour int, hr double, spo2 double")
    for capped in (True, False):
        got = preprocess_series(df, hour_capped=capped).orderBy("hour").collect()
        assert [r["hr"] for r in got] == [80, 80, 80, 85, 85, 300]
        assert got[5]["spo2"] == 50


def test_leading_nulls_stay(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 5.0)], "stay_id int, hour int, hr double")
    assert preprocess_series(df).orderBy("hour").first()["hr"] is None


def test_sequences_pad_and_truncate(spark):
    rows = [(1, h, float(h)) for h in range(5)] + [(2, 0, None), (2, 3, 4.0)]
    df = spark.createDataFrame(rows, "k int, h int, x double")
    got = {r["k"]: r["x"] for r in timeseries.padded_sequences(df, ["k"], "h", ["x"], 4).collect()}
    assert got == {1: [0.0, 1.0, 2.0, 3.0], 2: [0.0, 4.0, 0.0, 0.0]}
    grid = timeseries.dense_grid(df, ["k"], "h", ["x"]).where("k = 2").orderBy("h").collect()
    assert [r["x"] for r in grid] == [0.0, 0.0, 0.0, 4.0, 0.0]


def test_expressions(spark):
    df = spark.createDataFrame([("> 89", "4 Spontaneously", None, "Expired"), ("17", "none", 3.0, None), ("x", None, None, "alive")], "age string, text string, num double, label string")
    got = df.select(
        exprs.parse_with_sentinel("age").alias("age"), exprs.number_or_leading_digits("num", "text").alias("v"),
        exprs.flag_equals("label", "expired").alias("dead"),
    ).collect()
    assert [tuple(r) for r in got] == [(90, 4.0, 1), (17, 3.0, 0), (None, None, 0)]
    one = spark.range(1).select(
        exprs.bin_label(F.lit(50), [0, 50, 65], ["<50", "50-64"]).alias("left"),
        exprs.bin_label(F.lit(50), [0, 50, 65], ["<50", "50-64"], right_closed=True).alias("right"),
        exprs.clip(F.lit(None).cast("double"), 0, 1).alias("none"),
        exprs.hour_of_offset(F.lit(-1)).alias("h"),
    ).first()
    assert (one["left"], one["right"], one["none"], one["h"]) == ("50-64", "<50", None, -1)


def test_quartile_edges_fall_back_to_equal_width(spark):
    df = spark.createDataFrame([(1.0, 5.0), (1.0, 5.0), (1.0, 5.0), (9.0, 5.0)], "a double, flat double")
    e = prep.quartile_edges(df, ["a", "flat"])
    assert e["a"] == [1.0, 3.0, 9.0] and len(e["flat"]) == 5 and e["flat"][0] < 5.0 <= e["flat"][-1]


def test_reverse_one_hot_first_listed_wins(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 1)], "g_F int, g_M int")
    got = df.select(prep.reverse_one_hot(df, "g_", ["F", "M"], "M").alias("g")).collect()
    assert [r["g"] for r in got] == ["F", "F", "M"]


def test_pipeline(spark, tmp_path):
    cols = "subject_id long, stay_id long, gender string, anchor_age int, los double, has_afib int, lab_glucose double, hospital_expire_flag int, icd_code string"
    rows = [(i, i, "MF"[i % 2], 20 + i, 1.0 + i, i % 3 == 0 and 1 or 0, None if i % 7 == 0 else float(i), int(i % 5 == 0), "x") for i in range(60)]
    p = preprocess(spark.createDataFrame(rows, cols), categorical=["gender"])
    assert p.train.columns == p.val.columns == p.test.columns == sorted(p.train.columns)
    assert "icd_code" not in p.train.columns and {"gender_F", "gender_M", "lab_glucose_missing"} <= set(p.train.columns)
    lim = p.train.agg(F.min("los"), F.max("los"), F.min("gender_F"), F.max("hospital_expire_flag")).first()
    assert tuple(lim) == (-1.0, 1.0, -1.0, 1)
    assert p.train.count() + p.val.count() + p.test.count() == 60
    write_prepared(p, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/static_features_test.parquet").count() == p.test.count()


def test_columns_align(spark):
    a, b = spark.createDataFrame([(1, 2)], "b int, a int"), spark.createDataFrame([(3.0,)], "c double")
    x, y = prep.align_columns(a, b)
    assert x.columns == y.columns == ["a", "b", "c"] and y.first()["a"] == 0
    assert len(vocab.PROFILE_FEATURES) == 17


def test_wide_one_hot_and_back(spark):
    """100,000 categories: numbered without gaps in order, encoded by a join, inverted."""
    df = spark.range(200_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("a"), F.when(F.col("id") % 2 == 0, "even").alias("b"))
    index = prep.category_index(df, ["a", "b"])
    rows = [(r["variable"], r["category"], r["at"]) for r in index.orderBy("at").collect()]
    assert len(rows) > 100_000 and [r[2] for r in rows] == list(range(len(rows))) and rows == sorted(rows)
    hot = prep.sparse_indicators(df, index, ["a", "b"])
    assert hot.columns == ["id", "hot"]
    assert prep.from_indicators(hot, index, ["a", "b"]).exceptAll(df.select("id", "a", "b")).count() == 0
    few = prep.indicator_vectors(hot.where("id < 4"), len(rows), 2).orderBy("id").collect()
    assert all(v["features"].size == 2 * len(rows) for v in few)
    assert [sorted(int(i) for i in v["features"].indices) for v in few] == [
        sorted(x + k * len(rows) for k, x in enumerate(r["hot"]) if x is not None) for r in hot.where("id < 4").orderBy("id").collect()
    ]
