"""Privacy metrics of a synthetic table against the real one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.forests import forest_scores
from tidemark.operators.neighbors import as_vector, nearest_distances
from tidemark.operators.prep import apply_standard, fit_standard, random_sample
from tidemark.operators.skew import hash_rank, null_safe_join, quantiles
from tidemark.session import cut_lineage


def scaled_vectors(real: DataFrame, synth: DataFrame, cols: Sequence[str], real_id: str, synth_id: str):
    """Both tables as ``(id, vec)`` on the scale fitted on the real rows."""
    fit = fit_standard(real, cols)
    make = lambda d, i: apply_standard(d.select(i, *cols), fit).select(F.col(i).alias("id"), as_vector(cols).alias("vec"))
    return make(real, real_id), make(synth, synth_id)


def closest_record(real: DataFrame, synth: DataFrame, cols: Sequence[str], real_id: str, synth_id: str, **kw) -> DataFrame:
    """Distance of every synthetic row to its closest real row."""
    r, s = scaled_vectors(real, synth, cols, real_id, synth_id)
    return nearest_distances(s, r, "id", **kw).select(F.col("id"), F.col("distances")[0].alias("distance"))


def dcr_summary(distances: DataFrame, col: str = "distance", group: Sequence[str] = ()) -> DataFrame:
    """mean, median, min and 5th percentile of closest-record distances."""
    distances = cut_lineage(distances)  # read several times, computed once
    q = quantiles(distances, [col], [0.5, 0.05], group)
    agg = distances.groupBy(*group).agg(F.avg(col).alias("mean_dcr"), F.min(col).alias("min_dcr"))
    if group:
        joined = null_safe_join(agg, q.select(*group, "q0", "q1"), group)
        median, p5 = F.col("q0"), F.col("q1")
    else:
        row = q.first()
        joined, median, p5 = agg, F.lit(row["q0"] if row else None), F.lit(row["q1"] if row else None)
    return joined.select(*group, "mean_dcr", median.alias("median_dcr"), "min_dcr", p5.alias("p5_dcr"))


def membership_inference(
    real: DataFrame,
    synth: DataFrame,
    cols: Sequence[str],
    real_id: str,
    synth_id: str,
    leave_self_out: bool = False,
    seed: int = 42,
    **kw,
) -> DataFrame:
    """Guess "member" when the nearest real row is closer than the median; F1 of
    the guess, and mean / median nearest distance of the synthetic rows.

    Real rows are their own nearest row at distance 0 unless ``leave_self_out``.
    """
    r, s = scaled_vectors(real, synth, cols, real_id, synth_id)
    n_real, n_synth = r.count(), s.count()
    members = r if n_real <= n_synth else random_sample(r, ["id"], n_synth, seed)
    tag = lambda d, flag: d.select(
        F.concat(F.lit("m" if flag else "s"), F.col("id").cast("string")).alias("id"),
        "vec",
        F.lit(bool(flag and leave_self_out)).alias("skip"),
    )
    mixed = nearest_distances(
        tag(members, True).unionByName(tag(s, False)), r, "id", skip_self="skip", **kw
    ).select(F.col("id").startswith("m").alias("member"), F.col("distances")[0].alias("distance"))
    return attack_summary(mixed)


def membership_from_distances(
    distances: DataFrame, real: DataFrame, real_id: str, group: str, sizes: Mapping[int, int], seed: int = 42
) -> DataFrame:
    """The same attack for many datasets at once, from distances already known.

    Real rows are part of the reference side, so their distance is 0; as many
    of them as the dataset has rows take part. ``sizes`` is rows per dataset.
    """
    ranked = hash_rank(real.select(real_id), [real_id], seed)
    entries = F.array(*[F.struct(F.lit(d).alias(group), F.lit(n).alias("size")) for d, n in sizes.items()])
    members = ranked.select("rank", F.explode(entries).alias("e")).where(F.col("rank") <= F.col("e.size"))
    mixed = members.select(f"e.{group}", F.lit(True).alias("member"), F.lit(0.0).alias("distance")).unionByName(
        distances.select(group, F.lit(False).alias("member"), "distance")
    )
    return attack_summary(mixed, [group])


def attack_summary(mixed: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """``member, distance`` rows to ``mia_f1, median_nn_distance, mean_nn_distance``."""
    mixed = cut_lineage(mixed)

    def with_median(to: DataFrame, of: DataFrame, name: str) -> DataFrame:
        median = quantiles(of, ["distance"], [0.5], group)
        if group:
            return null_safe_join(to, median.select(*group, F.col("q0").alias(name)), group, "left")
        row = median.first()  # one number
        return to.withColumn(name, F.lit(row["q0"] if row else None).cast("double"))

    tagged = with_median(mixed, mixed, "threshold")
    guess = F.col("distance") < F.col("threshold")
    one = lambda c: F.sum(c.cast("long"))
    counts = tagged.groupBy(*group).agg(
        one(guess & F.col("member")).alias("tp"),
        one(guess & ~F.col("member")).alias("fp"),
        one(~guess & F.col("member")).alias("fn"),
        F.avg(F.when(~F.col("member"), F.col("distance"))).alias("mean_nn_distance"),
    )
    f1 = F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn"))
    return with_median(counts, mixed.where(~F.col("member")), "median_nn_distance").select(
        *group, F.coalesce(f1, F.lit(0.0)).alias("mia_f1"), "median_nn_distance", "mean_nn_distance"
    )


def attribute_inference(
    real: DataFrame, synth: DataFrame, sensitive: str, quasi_ids: Sequence[str], trees: int = 50, seed: int = 42,
    max_depth: int = 30,
) -> float:
    """Accuracy on real rows of a forest trained on synthetic quasi-identifiers;
    0 when the sensitive column is missing."""
    one = synth.withColumn("__d", F.lit(0))
    return attribute_inference_many(real, one, "__d", [0], sensitive, quasi_ids, trees, seed, max_depth)[0]


def attribute_inference_many(
    real: DataFrame, synth: DataFrame, dataset: str, ids: Sequence[int], sensitive: str, quasi_ids: Sequence[str], trees: int = 50,
    seed: int = 42, max_depth: int = 30,
) -> dict[int, float]:
    """``attribute_inference`` of every dataset of ``synth``, all forests grown in the same jobs."""
    if sensitive not in real.columns or sensitive not in synth.columns:
        return dict.fromkeys(ids, 0.0)
    cols = [c for c in quasi_ids if c in real.columns and c in synth.columns]
    make = lambda d, forest: d.select(
        forest.alias("forest"), F.col(sensitive).cast("double").alias("label"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(cols)]
    ).where(F.col("label").isNotNull())
    train = make(synth, F.col(dataset))
    seen = {r["forest"]: r for r in train.groupBy("forest").agg(F.min("label").alias("a"), F.max("label").alias("b")).collect()}
    if any(d not in seen for d in ids):
        raise ValueError("no synthetic rows to train on")
    out, grown = {}, []
    for d in ids:
        if seen[d]["a"] < seen[d]["b"]:
            grown.append(d)
        else:
            hit = make(real, F.lit(d)).agg(F.avg((F.col("label") == seen[d]["a"]).cast("double"))).first()[0]
            out[d] = float(hit or 0.0)
    if grown:
        test = make(real, F.explode(F.array(*[F.lit(d) for d in grown])))
        names = [f"x{i}" for i in range(len(cols))]
        scores = forest_scores(train.where(F.col("forest").isin(grown)), test, names, trees, seed, max_depth)
        shares = F.array(*[c for c in scores.columns if c.startswith("p")])
        right = (F.array_position(shares, F.array_max(shares)) - 1 == F.col("label")).cast("long") * F.col("n")
        found = {r["forest"]: r["hit"] for r in scores.groupBy("forest").agg((F.sum(right) / F.sum("n")).alias("hit")).collect()}
        out |= {d: float(found.get(d) or 0.0) for d in grown}
    return out
