"""What-if contrasts by matched resampling of observed trajectories.

A profile draws donors that share its discretised attributes, backing off to
coarser keys when none do. Donors are numbered inside each key, a draw is a
hashed number, and the join on (key, number) returns exactly one donor per draw:
profiles and donors of a key are never paired with each other.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import hash_uniform
from tidemark.operators.skew import hash_rank
from tidemark.session import cut_lineage

#: Profiles that one task gives their draws.
PROFILE_ROWS = 100_000


def expand_scenarios(
    profiles: DataFrame, scenarios: Mapping[str, Mapping[str, object]], name: str = "scenario"
) -> DataFrame:
    """Every profile under every named override; an empty override is the baseline."""
    touched = sorted({a for over in scenarios.values() for a in over})
    types = dict(profiles.dtypes)
    rows = [
        F.struct(
            F.lit(s).alias(name),
            *[F.lit(over.get(a)).cast(types[a]).alias(f"__o_{a}") for a in touched],
            *[F.lit(a in over).alias(f"__h_{a}") for a in touched],
        )
        for s, over in scenarios.items()
    ]
    out = profiles.select("*", F.explode(F.array(*rows)).alias("__s"))
    changed = {a: F.when(F.col(f"__s.__h_{a}"), F.col(f"__s.__o_{a}")).otherwise(F.col(a)) for a in touched}
    return out.withColumn(name, F.col(f"__s.{name}")).withColumns(changed).drop("__s")


def _match_key(attrs: Sequence[str]) -> Column:
    parts = [F.concat(F.lit(f"{a}="), F.coalesce(F.col(a).cast("string"), F.lit("nan"))) for a in attrs]
    return F.concat_ws("|", F.lit(str(len(attrs))), *parts)


def draw_donors(
    profiles: DataFrame,
    donors: DataFrame,
    profile_keys: Sequence[str],
    donor_id: str,
    attributes: Sequence[str],
    n_draws: int,
    seed: int = 42,
) -> DataFrame:
    """``profile_keys..., draw, matched_on, donor_id``: ``n_draws`` donors per profile.

    Attributes are matched from all of them down to none, last one dropped first.
    """
    levels = [list(attributes[:k]) for k in range(len(attributes), -1, -1)]
    tagged = donors.select(donor_id, F.explode(F.array(*[_match_key(a) for a in levels])).alias("key"))
    # narrow rows, read twice: once per key for its size, once for the draws
    ranked = cut_lineage(hash_rank(tagged, [donor_id], seed, ["key"]))
    sizes = ranked.where("rank = 1").select("key", F.col("stratum_rows").alias("size"))
    # one row per key; its number stands for it from here on
    sizes = cut_lineage(sizes.withColumn("number", F.monotonically_increasing_id()))
    own = list(dict.fromkeys([*profile_keys, *attributes]))
    want = profiles.select(*own)
    want = want.repartition(max(1, math.ceil(want.count() / PROFILE_ROWS)), *profile_keys)
    found = []
    for a in levels:
        i = len(a)
        at = sizes.select(F.col("key").alias(f"__k{i}"), F.struct(F.lit(i).alias("matched_on"), "key", "size", "number").alias(f"__b{i}"))
        want = want.join(at, _match_key(a) == F.col(f"__k{i}"), "left")
        found.append(F.col(f"__b{i}"))
    # a profile that comes twice draws once
    best = want.groupBy(*profile_keys).agg(F.max(F.coalesce(*found)).alias("b")).where("b IS NOT NULL").select(
        *profile_keys, "b.matched_on", "b.size", "b.number"
    )
    draws = best.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
    u = hash_uniform(F.lit(seed), *[F.col(c) for c in profile_keys], F.col("draw"))
    draws = draws.withColumn("rank", (F.floor(u * F.col("size")) + 1).cast("long")).drop("size")
    places = ranked.join(sizes.select("key", "number"), "key").select("number", "rank", donor_id)
    return draws.join(places, ["number", "rank"]).select(*profile_keys, "draw", "matched_on", donor_id)


def conditional_trajectories(
    draws: DataFrame, series: DataFrame, donor_id: str
) -> DataFrame:
    """Attach the donors' series to the draws."""
    return draws.join(series, donor_id)


def compare_scenarios(
    trajectories: DataFrame, channels: Sequence[str], by: Sequence[str] = ("scenario",), hour: str = "hour"
) -> DataFrame:
    """Mean and population std per (scenario, hour) and channel."""
    return trajectories.groupBy(*by, hour).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in channels],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in channels],
    )


def mean_of_last_step(channels: Sequence[str]) -> Column:
    """Default outcome: mean of the channels at the last step (NULL read as 0)."""
    total = F.lit(0.0)
    for c in channels:
        total = total + F.coalesce(F.col(c), F.lit(0.0))
    return total / F.lit(float(len(channels)))


def associational_difference(
    trajectories: DataFrame,
    channels: Sequence[str],
    baseline: str,
    modified: str,
    draw_keys: Sequence[str],
    outcome: Column | None = None,
    arm: str = "scenario",
    hour: str = "hour",
) -> DataFrame:
    """Outcome mean and population std per arm and their difference.

    ``outcome`` is a column over the last step of a draw.
    """
    last = (
        trajectories.where(F.col(arm).isin(baseline, modified))
        .groupBy(arm, *draw_keys)
        .agg(F.max_by(F.struct(*channels), F.col(hour)).alias("last"))
        .select(arm, *draw_keys, "last.*")
    )
    y = last.select(arm, (outcome if outcome is not None else mean_of_last_step(channels)).alias("y"))
    pick = lambda fn, a: fn(F.when(F.col(arm) == a, F.col("y")))
    wide = y.agg(
        pick(F.avg, baseline).alias("baseline_mean"),
        pick(F.avg, modified).alias("modified_mean"),
        pick(F.stddev_pop, baseline).alias("baseline_std"),
        pick(F.stddev_pop, modified).alias("modified_std"),
    )
    return wide.select(
        (F.col("modified_mean") - F.col("baseline_mean")).alias("associational_difference"), "*"
    )


def repeated_draw_moments(
    trajectories: DataFrame, entity: Sequence[str], channels: Sequence[str], hour: str = "hour"
) -> DataFrame:
    """Mean and population std over the draws per (entity, hour, channel)."""
    wide = compare_scenarios(trajectories, channels, entity, hour)
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("channel"), F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_std").alias("std"))
            for c in channels
        ]
    )
    return wide.select(*entity, hour, F.explode(entries).alias("e")).select(*entity, hour, "e.*")


def moments_of_draws(
    draws: DataFrame, series: DataFrame, entity: Sequence[str], donor_id: str, channels: Sequence[str], hour: str = "hour"
) -> DataFrame:
    """``repeated_draw_moments`` of the draws' trajectories.

    A donor's series is one row of steps; draws take it along to their entity and are spread into steps only there, so steps are
    never shuffled on their own. An entity has as many rows as draws.
    """
    steps = series.groupBy(donor_id).agg(F.collect_list(F.struct(hour, *channels)).alias("__steps"))
    packed = draws.select(*entity, donor_id).join(steps, donor_id).select(*entity, "__steps").repartition(*entity)
    return repeated_draw_moments(packed.select(*entity, F.explode("__steps").alias("s")).select(*entity, "s.*"), entity, channels, hour)


def ensemble_moments(
    sources: Mapping[str, DataFrame], entity: Sequence[str], channels: Sequence[str], draws_per_source: int,
    hour: str = "hour", draw: str = "draw",
) -> DataFrame:
    """Pool several draw sources, the same number of draws from each."""
    pooled = None
    for name, df in sources.items():
        part = df.where(F.col(draw) <= draws_per_source).withColumn("source", F.lit(name))
        pooled = part if pooled is None else pooled.unionByName(part)
    return repeated_draw_moments(pooled, entity, channels, hour)
