"""Fidelity of a synthetic table: marginals, correlations, separability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.models import discriminator_aucs
from tidemark.operators.profiles import correlations
from tidemark.operators.skew import null_safe_join
from tidemark.operators.stattests import both_sides, ks_tests, shared_numeric


def dimension_wise(
    real: DataFrame, synth: DataFrame, cols: Sequence[str] | None = None, group: Sequence[str] = ()
) -> DataFrame:
    """KS test per shared numeric column."""
    return ks_tests(real, synth, cols or shared_numeric(real, synth), group)


def mean_pvalue(tests: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Mean p-value over the tested columns, 0 when none was tested."""
    return tests.groupBy(*group).agg(F.coalesce(F.avg("pvalue"), F.lit(0.0)).alias("avg_ks_pvalue"))


def correlation_distance(
    real: DataFrame, synth: DataFrame, cols: Sequence[str] | None = None, group: Sequence[str] = ()
) -> DataFrame:
    """Frobenius norm of the difference of the two Pearson matrices."""
    cols = cols or shared_numeric(real, synth)
    both = correlations(both_sides(real, synth, cols, group), cols, [*group, "is_real"])
    signed = F.when(F.col("is_real") == 1, F.col("r")).otherwise(-F.col("r"))
    pairs = both.groupBy(*group, "a", "b").agg(F.sum(signed).alias("d"))
    return pairs.groupBy(*group).agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("frobenius_distance"))


def discriminator(
    real: DataFrame, synth: DataFrame, cols: Sequence[str], ids: Sequence[str], folds: int = 5, seed: int = 42
) -> dict:
    """Cross-validated AUC of a logistic model telling real from synthetic rows."""
    found = discriminator_aucs(real, synth.withColumn("__d", F.lit(0)), cols, ids, "__d", folds, seed).first()
    return {"auc": found["auc"], "auc_std": found["auc_std"]}


def category_shares(real: DataFrame, synth: DataFrame, col: str, group: Sequence[str] = ()) -> DataFrame:
    """Share of every category on either side, 0 where it is absent."""
    both = both_sides(real, synth, [col], group).where(F.col(col).isNotNull())
    counts = both.groupBy(*group, F.col(col).alias("category")).agg(
        F.sum(F.col("is_real")).alias("nr"), F.sum(1 - F.col("is_real")).alias("ns")
    )
    sums = both.groupBy(*group).agg(F.sum("is_real").alias("tr"), F.sum(1 - F.col("is_real")).alias("ts"))
    if group:
        counts = null_safe_join(counts, sums, group)
    else:
        whole = sums.first()  # two numbers
        counts = counts.withColumns({"tr": F.lit(whole["tr"]).cast("long"), "ts": F.lit(whole["ts"]).cast("long")})
    return counts.select(
        *group,
        "category",
        F.try_divide("nr", "tr").alias("real_share"),
        F.try_divide("ns", "ts").alias("synth_share"),
    )


def category_abundance(real: DataFrame, synth: DataFrame, col: str, group: Sequence[str] = ()) -> DataFrame:
    """L1 distance of the two category distributions."""
    return category_shares(real, synth, col, group).groupBy(*group).agg(
        F.sum(F.abs(F.col("real_share") - F.col("synth_share"))).alias("mca_manhattan")
    )
