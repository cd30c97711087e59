"""Side-by-side comparison of two cohorts with tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.operators.skew import quantiles
from tidemark.operators.stattests import chi_square, mann_whitney, welch
from tidemark.session import cut_lineage


def stack_cohorts(first: DataFrame, second: DataFrame, labels: tuple[str, str]) -> DataFrame:
    """Tagged union on the compared columns; an absent column is all NULL."""
    want = {"anchor_age": "double", "gender": "string", "hospital_expire_flag": "double", "los": "double", "stroke_subtype": "string"}

    def shape(df, label):
        names = set(df.columns)
        def get(c, t):
            src = "age" if c == "anchor_age" and c not in names and "age" in names else c
            return (F.col(src).try_cast(t) if src in names else F.lit(None).cast(t)).alias(c)
        return df.select(F.lit(label).alias("source"), *[get(c, t) for c, t in want.items()])

    return shape(first, labels[0]).unionByName(shape(second, labels[1]))


def cohort_metrics(stacked: DataFrame, digits: int = 1) -> DataFrame:
    """``source, metric, value`` rows for both cohorts from one grouped pass."""
    male = F.col("gender").isin("M", "Male")
    known = F.count("stroke_subtype")
    share = {s: F.try_divide(F.sum((F.col("stroke_subtype") == s).cast("long")) * 100.0, known) for s in vocab.SUBTYPES}
    wide = stacked.groupBy("source").agg(
        F.count(F.lit(1)).cast("double").alias("n_patients"),
        F.avg("anchor_age").alias("age_mean"),
        F.stddev_samp("anchor_age").alias("age_std"),
        (F.avg(F.when(F.coalesce(male, F.lit(False)), 100.0).otherwise(0.0))).alias("pct_male"),
        (F.avg("hospital_expire_flag") * 100.0).alias("mortality_pct"),
        *[F.coalesce(e, F.when(known > 0, 0.0)).alias(f"subtype_{s}_pct") for s, e in share.items()],
    )
    names = [c for c in wide.columns if c != "source"]
    entries = F.array(*[F.struct(F.lit(c).alias("metric"), F.round(F.col(c), digits).alias("value")) for c in names])
    means = wide.select("source", F.explode(entries).alias("e")).select("source", "e.*")
    q = quantiles(stacked, ["anchor_age", "los"], [0.25, 0.5, 0.75], ["source"])
    is_age = F.col("variable") == "anchor_age"
    rows = F.when(
        is_age, F.array(F.struct(F.lit("age_median").alias("metric"), F.round("q1", digits).alias("value")))
    ).otherwise(
        F.array(
            F.struct(F.lit("los_median_days").alias("metric"), F.round("q1", digits).alias("value")),
            F.struct(F.lit("los_iqr_25").alias("metric"), F.round("q0", digits).alias("value")),
            F.struct(F.lit("los_iqr_75").alias("metric"), F.round("q2", digits).alias("value")),
        )
    )
    return means.unionByName(q.select("source", F.explode(rows).alias("e")).select("source", "e.*"))


def compare_cohorts(first: DataFrame, second: DataFrame, labels: tuple[str, str] = ("primary", "external")) -> DataFrame:
    """``metric, <first label>, <second label>, p_value``.

    Each p-value is attached to the metrics it tests: age (Welch), gender and
    mortality (chi-square), length of stay (Mann–Whitney).
    """
    both = cut_lineage(stack_cohorts(first, second, labels))  # read by every metric and test, made once
    metrics = cohort_metrics(both)
    a, b = labels
    table = metrics.groupBy("metric").agg(
        F.max(F.when(F.col("source") == a, F.col("value"))).alias(a),
        F.max(F.when(F.col("source") == b, F.col("value"))).alias(b),
    )
    flags = both.select(
        "source",
        F.when(F.coalesce(F.col("gender").isin("M", "Male"), F.lit(False)), "1").otherwise("0").alias("gender"),
        F.col("hospital_expire_flag").cast("int").cast("string").alias("mortality"),
    )
    p = (
        welch(both, ["anchor_age"], "source", a, b).select("variable", "pvalue")
        .unionByName(chi_square(flags, ["gender", "mortality"], "source").select("variable", "pvalue"))
        .unionByName(mann_whitney(both, ["los"], "source", a, b).select("variable", "pvalue"))
    )
    test_of = (
        F.when(F.col("metric").isin("age_mean", "age_std", "age_median"), "anchor_age")
        .when(F.col("metric") == "pct_male", "gender")
        .when(F.col("metric") == "mortality_pct", "mortality")
        .when(F.col("metric").startswith("los_"), "los")
    )
    return (
        table.withColumn("variable", test_of).join(p, "variable", "left")
        .select("metric", a, b, F.round("pvalue", 4).alias("p_value"))
    )
