"""Synthetic entities: profiles from the network, series from matched donors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bayes import ProfileNetwork, discretise, pair_static_with_series
from tidemark.operators.scenario import conditional_trajectories, draw_donors
from tidemark.session import cut_lineage


def generate_static(net: ProfileNetwork, n: int, seed: int = 42, datasets: int = 1) -> DataFrame:
    """Profiles only."""
    return net.sample(n, seed, datasets)


def generate_complete(
    net: ProfileNetwork,
    n: int,
    static: DataFrame,
    series: DataFrame,
    match_on: Sequence[str],
    key: str = "stay_id",
    seed: int = 42,
    datasets: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """(profiles, series): every profile gets the series of an observed donor
    that shares its states of ``match_on``, most important first."""
    states = cut_lineage(net.sample_states(n, seed, datasets))
    donors = discretise(pair_static_with_series(static, series, key), match_on, net.edges, net.fixed_bins, keep=[key])
    draws = draw_donors(states, donors, ["dataset_id", "row_id"], key, match_on, 1, seed)
    ts = conditional_trajectories(draws.drop("draw", "matched_on"), series, key).drop(key)
    return net.to_values(states), ts
