"""Plausibility rules: violations and rates per rule and in total."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.operators.prep import invert_minmax


def check_rules(
    df: DataFrame,
    rules: Mapping[str, tuple[Sequence[str], str]] = vocab.PLAUSIBILITY_RULES,
    norm_params: Mapping | None = None,
    group: Sequence[str] = (),
) -> DataFrame:
    """``group..., rule, violations, violation_rate`` plus a ``total`` row.

    A NULL reading violates its rule; a rule whose column is absent passes; the
    total always divides by the number of rules. With ``norm_params`` the rows
    are brought back to their original scale first.
    """
    if norm_params is not None:
        df = invert_minmax(df, norm_params)
    bad = {}
    for name, (cols, predicate) in rules.items():
        known = all(c in df.columns for c in cols)
        holds = F.coalesce(F.expr(predicate), F.lit(False)) if known else F.lit(True)
        bad[name] = F.sum((~holds).cast("long"))
    wide = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[e.alias(k) for k, e in bad.items()])
    total = sum((F.coalesce(F.col(k), F.lit(0)) for k in bad), F.lit(0).cast("long"))

    def row(name, v, denom):
        rate = F.coalesce(F.try_divide(v.cast("double"), denom), F.lit(0.0))
        return F.struct(F.lit(name).alias("rule"), v.cast("long").alias("violations"), rate.alias("violation_rate"))

    rows = [row(k, F.coalesce(F.col(k), F.lit(0)), F.col("n")) for k in bad]
    rows.append(row("total", total, F.col("n") * F.lit(len(rules))))
    return wide.select(*group, F.explode(F.array(*rows)).alias("e")).select(*group, "e.*")
