"""Cohort extraction and static features: filters, joins, first/best records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions.exprs import any_of, code_match
from tidemark.operators.skew import first_by


def dictionary_join(
    codes: DataFrame, dictionary: DataFrame, on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join to a code dictionary. Spark broadcasts the dictionary by itself
    when its measured size allows it; a large one is shuffled."""
    return codes.join(dictionary, list(on), how)


def within_los(los: Column, min_hours: float, max_days: float) -> Column:
    """Length of stay in days between a bound in hours and a bound in days."""
    return (los >= F.lit(min_hours / 24.0)) & (los <= F.lit(float(max_days)))


def restrict_to(df: DataFrame, keep: DataFrame, on: Sequence[str]) -> DataFrame:
    """Semi-join: rows whose key occurs in ``keep`` (which may repeat keys)."""
    return df.join(keep.select(*on), list(on), "left_semi")


def first_record(df: DataFrame, key: str, time: str, ties: Sequence[str]) -> DataFrame:
    """First record per key by time, with stated tie-breakers."""
    order = [F.col(time).asc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]
    return first_by(df, [key], order)


def best_record(df: DataFrame, key: str, score: str, ties: Sequence[str]) -> DataFrame:
    """Highest score per key, NULL scores last."""
    order = [F.col(score).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]
    return first_by(df, [key], order)


def code_flags(
    spine: DataFrame,
    codes: DataFrame,
    on: Sequence[str],
    flags: Mapping[str, Mapping[int, Sequence[str]]] = vocab.COMORBIDITY_PREFIXES,
    code: str = "icd_code",
    version: str = "icd_version",
) -> DataFrame:
    """The spine with 0/1 flag columns; spine rows without any code get 0.

    Codes are reduced to one row per key before the join (map-side combine), so
    the join sees at most one row per key on either side.
    """
    hits = {name: code_match(code, version, prefixes) for name, prefixes in flags.items()}
    reduced = (
        codes.where(any_of(hits.values()))
        .groupBy(*on)
        .agg(*[F.max(F.when(c, 1).otherwise(0)).alias(n) for n, c in hits.items()])
    )
    return spine.join(reduced, list(on), "left").select(
        *[spine[c] for c in spine.columns], *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in hits]
    )


def first_values_in_window(
    spine: DataFrame,
    log: DataFrame,
    on: Sequence[str],
    start: str,
    window: str,
    item: str,
    items: Mapping[int | str, str],
    value: str,
    time: str,
    ties: Sequence[str] = (),
) -> DataFrame:
    """First value of every item in ``[start, start + window]``, one column per item.

    Item and NULL filters reach the scan; the pick is ``min_by`` under a
    map-side combine, so filter, join and one aggregation are all there is.
    """
    wanted = log.where(F.col(item).isin(list(items)) & F.col(value).isNotNull())
    joined = wanted.join(spine.select(*on, F.col(start).alias("__start")), list(on)).where(
        (F.col(time) >= F.col("__start")) & (F.col(time) <= F.col("__start") + F.expr(f"INTERVAL {window}"))
    )
    rank = F.struct(F.col(time), *[F.col(t) for t in ties], F.col(value))
    return joined.groupBy(*on).agg(
        *[F.min_by(F.col(value), F.when(F.col(item) == i, rank)).alias(n) for i, n in items.items()]
    )


def star_join(spine: DataFrame, on: Sequence[str], *features: DataFrame) -> DataFrame:
    """Left-join feature tables (one row per key each) on a spine."""
    for f in features:
        spine = spine.join(f, list(on), "left")
    return spine


def key_map(df: DataFrame, mapping: DataFrame, key: str, target: str, how: str = "left") -> DataFrame:
    """Add ``target`` looked up by ``key`` from a de-duplicated two-column map."""
    return df.join(mapping.select(key, target).dropDuplicates([key]), key, how)
