"""A discrete Bayesian network over profile columns as count and join jobs.

Counting is the only part that sees the data: profiles are reduced to distinct
combinations once, families are counted together in one pass, and what comes
back to the driver is one score per candidate family. Parent states are arrays,
so any text is told apart. States, probability tables and samples are tables of
any size: a child's state is drawn by a join on its parents' states and the slot
of the unit interval that its uniform number falls in.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions.exprs import bin_label, hash_uniform
from tidemark.operators.prep import category_index, quartile_edges, quartile_label
from tidemark.session import cut_lineage

#: States of one parent combination that share a slot of the unit interval when a child is drawn.
SLOT_STATES = 8
#: Cells that a task counts in arrays, and the number below which the codes of a column set stay.
DENSE_CELLS, MOST_CODES = 1 << 21, 1 << 62
Family = tuple[str, tuple[str, ...]]


# ---- discretise -----------------------------------------------------------
def discretise(
    df: DataFrame,
    features: Sequence[str],
    edges: Mapping[str, object],
    fixed_bins: Mapping[str, tuple] = vocab.FIXED_BINS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Every feature as a text state; out-of-range and NULL become ``nan``."""
    out: list[Column] = [F.col(c) for c in keep]
    for c in features:
        if c in fixed_bins:
            b_edges, labels = fixed_bins[c]
            value = F.col(c).cast("double")
            value = F.when(value < 0, 0.0).otherwise(value) if c == "los" else value
            e = bin_label(value, b_edges, labels)
        elif c in edges:
            e = quartile_label(c, edges[c], edges[f"{c}__fill"])
        else:
            e = F.col(c).cast("string")
        out.append(F.coalesce(e, F.lit("nan")).alias(c))
    return df.select(*out)


def distinct_profiles(data: DataFrame, features: Sequence[str]) -> DataFrame:
    """Distinct state combinations with their counts: repeated profiles shrink
    before any family is counted."""
    return data.groupBy(*features).agg(F.count(F.lit(1)).alias("weight"))


@dataclass
class States:
    """``table``: node, state and its place ``at`` among the node's states in order; ``counts``: their number per node."""

    table: DataFrame
    counts: dict[str, int]

    def of(self, node: str) -> DataFrame:
        return self.table.where(F.col("node") == node).select("state", "at")


def states_of(profiles: DataFrame, features: Sequence[str]) -> States:
    """All states of all features as a table. The driver sees one number per feature."""
    index = category_index(profiles, features)
    spans = {r["variable"]: (r["lo"], r["n"]) for r in index.groupBy("variable").agg(F.min("at").alias("lo"), F.count(F.lit(1)).alias("n")).collect()}
    first = F.lit(0)
    for c, (lo, _) in spans.items():
        first = F.when(F.col("variable") == c, F.lit(lo)).otherwise(first)
    table = index.select(F.col("variable").alias("node"), F.col("category").alias("state"), (F.col("at") - first).cast("bigint").alias("at"))
    return States(table, {c: spans.get(c, (0, 0))[1] for c in features})


# ---- counts and scores ----------------------------------------------------
def parent_states(parents: Sequence[str]) -> Column:
    """The parents' states as an array, empty without parents."""
    return F.array(*[F.col(p).cast("string") for p in parents]).cast("array<string>")


def parent_text(parents: Mapping[str, Sequence[str]], node: str = "node", states: str = "parent_states") -> Column:
    """``a=x|b=y`` for reading; tables are joined on the arrays."""
    text = F.lit("")
    for v, ps in parents.items():
        if ps:
            named = F.zip_with(F.array(*[F.lit(p) for p in ps]), F.col(states), lambda p, x: F.concat(p, F.lit("="), x))
            text = F.when(F.col(node) == v, F.array_join(named, "|")).otherwise(text)
    return text


def family_counts(profiles: DataFrame, families: Sequence[Family]) -> DataFrame:
    """``family, node, parent_states, state, n`` for many families in one pass."""
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("family"), F.lit(node).alias("node"),
                parent_states(parents).alias("parent_states"), F.col(node).cast("string").alias("state"),
            )
            for i, (node, parents) in enumerate(families)
        ]
    )
    return (
        profiles.select("weight", F.explode(entries).alias("e")).select("weight", "e.*")
        .groupBy("family", "node", "parent_states", "state").agg(F.sum("weight").alias("n"))
    )


def log_likelihoods(counts: DataFrame) -> DataFrame:
    """Per family Σ n·ln(n / n_parents), without a window over a family."""
    n = F.col("n").cast("double")
    per_parent = counts.groupBy("family", "parent_states").agg(
        F.sum(n).alias("np"), F.sum(n * F.log(n)).alias("nlogn")
    )
    return per_parent.groupBy("family").agg(
        F.sum(F.col("nlogn") - F.col("np") * F.log("np")).alias("log_likelihood")
    )


def joint_counts(profiles: DataFrame, sets: Sequence[tuple[str, ...]]) -> DataFrame:
    """``set_id, states, n``: joint counts of several column sets in one pass."""
    entries = F.array(
        *[F.struct(F.lit(i).alias("set_id"), F.array(*[F.col(c) for c in cols]).alias("states")) for i, cols in enumerate(sets)]
    )
    return (
        profiles.select("weight", F.explode(entries).alias("e")).select("weight", "e.*")
        .groupBy("set_id", "states").agg(F.sum("weight").alias("n"))
    )


def coded_profiles(profiles: DataFrame, features: Sequence[str], states: States) -> DataFrame:
    """``x, weight``: profiles as numbers, per feature 1 + the place of its state, 0 for none. A written table."""
    out = profiles
    for i, c in enumerate(features):
        at = states.of(c).select(F.col("state").alias(f"__s{i}"), (F.col("at") + 1).alias(f"__x{i}"))
        out = out.join(at, F.col(c).cast("string") == F.col(f"__s{i}"), "left")
    x = F.array(*[F.coalesce(F.col(f"__x{i}"), F.lit(0)).cast("bigint") for i in range(len(features))])
    return cut_lineage(out.select(x.alias("x"), F.col("weight").cast("bigint").alias("weight")))


def code_counts(coded: DataFrame, sets: Sequence[tuple[tuple[int, int], ...]], sizes: Sequence[int]) -> DataFrame:
    """``set_id, code, n``: joint counts of several column sets in one pass.

    A set is (column, place) pairs, a code the sum of numbers times places, below the set's size. Tasks add up small sets in
    arrays and hand on the codes that occur; a large set's codes are handed on by batch.
    """
    dense, cells = set(), 0
    for i in sorted(range(len(sets)), key=lambda i: sizes[i]):
        if cells + sizes[i] <= DENSE_CELLS:
            dense.add(i)
            cells += sizes[i]

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def out(i, codes, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), i, np.int32)), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], ["set_id", "code", "n"])

        held: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, weight = pc.list_flatten(b["x"]).to_numpy().reshape(b.num_rows, -1).T, b["weight"].to_numpy()
            for i, members in enumerate(sets):
                code = np.zeros(b.num_rows, np.int64)
                for column, place in members:
                    code += x[column] * place
                if i in dense:
                    held[i] = held.get(i, 0) + np.bincount(code, weight, sizes[i])  # whole numbers below 2 ** 53
                else:
                    codes, at = np.unique(code, return_inverse=True)
                    yield out(i, codes, np.bincount(at, weight))
        for i, n in held.items():
            codes = np.flatnonzero(n)
            yield out(i, codes, n[codes])

    return coded.mapInArrow(count, "set_id int, code bigint, n bigint").groupBy("set_id", "code").agg(F.sum("n").alias("n"))


def bic_scores(
    profiles: DataFrame, families: Sequence[Family], states: States, n_rows: int, coded: DataFrame | None = None
) -> dict[Family, float]:
    """BIC of every family: log-likelihood less ½·ln N per free parameter.

    Families over the same columns (x given y, y given x) share one joint count,
    so the pass over the data makes each column set only once. ``coded`` is
    ``coded_profiles`` of all features, made once by callers that ask often.
    Sets with more combinations than a number holds are counted by their states.
    """
    features = list(states.counts)
    members = [tuple(sorted((node, *parents))) for node, parents in families]
    radix = {c: n + 1 for c, n in states.counts.items()}
    size = {m: math.prod(radix[c] for c in m) for m in members}
    place = {m: {c: math.prod(radix[d] for d in m[:k]) for k, c in enumerate(m)} for m in members}
    spark = profiles.sparkSession
    ll: dict[int, float] = {}
    for numbers in (True, False):
        own = [i for i, m in enumerate(members) if (size[m] < MOST_CODES) == numbers]
        if not own:
            continue
        sets = sorted({members[i] for i in own})
        where = {cols: i for i, cols in enumerate(sets)}
        # one row per family: a few hundred
        if numbers:
            rows = [(i, where[members[i]], place[members[i]][families[i][0]], radix[families[i][0]]) for i in own]
            lookup = F.broadcast(spark.createDataFrame(rows, "family int, set_id int, place long, radix long"))
            if coded is None:
                coded = coded_profiles(profiles, features, states)
            counts = code_counts(coded, [tuple((features.index(c), place[m][c]) for c in m) for m in sets], [size[m] for m in sets])
            rest = F.expr("code - ((code div place) % radix) * place")
        else:
            lookup = F.broadcast(spark.createDataFrame([(i, where[members[i]], members[i].index(families[i][0])) for i in own], "family int, set_id int, node_at int"))
            counts = joint_counts(profiles, sets)
            rest = F.filter("states", lambda s, i: i != F.col("node_at"))
        found = log_likelihoods(counts.join(lookup, "set_id").select("family", rest.alias("parent_states"), "n"))
        ll |= {r["family"]: r["log_likelihood"] for r in found.collect()}
    out = {}
    for i, (node, parents) in enumerate(families):
        q = math.prod(states.counts[p] for p in parents)
        out[node, parents] = ll[i] - 0.5 * math.log(n_rows) * q * (states.counts[node] - 1)
    return out


# ---- structure ------------------------------------------------------------
def _reaches(parents: Mapping[str, set], start: str, goal: str) -> bool:
    """Is there a directed path start -> goal?"""
    stack, seen = [goal], set()
    while stack:
        v = stack.pop()
        if v == start:
            return True
        if v not in seen:
            seen.add(v)
            stack.extend(parents[v])
    return False


def learn_structure(
    profiles: DataFrame, features: Sequence[str], states: States, n_rows: int,
    max_indegree: int = 3, epsilon: float = 1e-4, tabu: int = 100,
) -> dict[str, set]:
    """Greedy add / remove / reverse search on BIC. The driver holds only scores
    of the few hundred candidate families; each step costs at most one count job."""
    parents: dict[str, set] = {v: set() for v in features}
    scores: dict[Family, float] = {}
    coded = coded_profiles(profiles, list(states.counts), states)
    barred: deque = deque(maxlen=tabu)
    fam = lambda v, ps: (v, tuple(sorted(ps)))

    def moves():
        for u in features:
            for v in features:
                if u == v:
                    continue
                if u in parents[v]:
                    if ("remove", u, v) not in barred:
                        yield ("remove", u, v), [(v, parents[v] - {u})]
                    if ("flip", u, v) not in barred and len(parents[u]) < max_indegree:
                        rest = {w: set(p) for w, p in parents.items()}
                        rest[v].discard(u)
                        if not _reaches(rest, u, v):
                            yield ("flip", u, v), [(v, parents[v] - {u}), (u, parents[u] | {v})]
                elif v not in parents[u] and ("add", u, v) not in barred and len(parents[v]) < max_indegree:
                    if not _reaches(parents, v, u):
                        yield ("add", u, v), [(v, parents[v] | {u})]

    while True:  # every step gains more than epsilon on a bounded score
        options = list(moves())
        need = {fam(v, ps) for _, change in options for v, ps in change}
        need |= {fam(v, parents[v]) for v in features}
        missing = sorted(need - scores.keys())
        if missing:
            scores |= bic_scores(profiles, missing, states, n_rows, coded)
        best, gain = None, epsilon
        for move, change in options:
            delta = sum(scores[fam(v, ps)] - scores[fam(v, parents[v])] for v, ps in change)
            if delta > gain:
                best, gain = (move, change), delta
        if best is None:
            break
        (kind, u, v), change = best
        for w, ps in change:
            parents[w] = set(ps)
        undo = {"add": ("remove", u, v), "remove": ("add", u, v), "flip": ("flip", v, u)}
        barred.append(undo[kind])
    return parents


# ---- probability tables ---------------------------------------------------
def _combinations(spark: SparkSession, parents: Sequence[str], states: States) -> DataFrame:
    """All combinations of parent states, one column per parent: numbers of a range, taken apart by the numbers of states."""
    out = spark.range(math.prod(states.counts[p] for p in parents))
    rest = F.col("id")
    for p in parents:
        out = out.withColumn(f"__{p}", F.pmod(rest, F.lit(states.counts[p])))
        rest = F.floor(rest / F.lit(states.counts[p]))
    for p in parents:
        out = out.join(states.of(p).select(F.col("at").alias(f"__{p}"), F.col("state").alias(p)), f"__{p}")
    return out.select(parent_states(parents).alias("parent_states"))


def probability_tables(
    profiles: DataFrame, parents: Mapping[str, Sequence[str]], states: States, n_rows: int,
    equivalent_sample_size: float = 10.0, full: bool = True,
) -> DataFrame:
    """``node, parent_states, state, n, prob, cum_lo, cum_hi``.

    Nodes with an edge get the BDeu estimate; isolated ones their plain shares. With ``full`` all combinations of parent states
    are listed, else those that occur: any other has equal shares for all states.
    """
    families = [(v, tuple(sorted(ps))) for v, ps in parents.items()]
    linked = {v for v, ps in parents.items() if ps} | {p for ps in parents.values() for p in ps}
    counts = cut_lineage(family_counts(profiles, families).drop("family"))
    grid = None
    for v, ps in families:
        own = counts.where(F.col("node") == v)
        rows = _combinations(profiles.sparkSession, ps, states) if full and ps else own.select("parent_states").distinct()
        q, r = math.prod(states.counts[p] for p in ps), states.counts[v]
        at = rows.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(r - 1).cast("bigint"))))
        ess = equivalent_sample_size if v in linked else 0.0
        part = at.join(states.of(v), "at").select(
            F.lit(v).alias("node"), "parent_states", "state", F.lit(ess / (q * r)).alias("prior"), F.lit(ess / q).alias("prior_row")
        )
        grid = part if grid is None else grid.unionByName(part)
    key = ["node", "parent_states"]
    full_counts = grid.join(counts, [*key, "state"], "left").withColumn("n", F.coalesce(F.col("n"), F.lit(0)))
    rowsum = Window.partitionBy(*key)  # at most one row per state
    prob = (F.col("n") + F.col("prior")) / (F.sum("n").over(rowsum) + F.col("prior_row"))
    upto = rowsum.orderBy("state").rowsBetween(Window.unboundedPreceding, 0)
    out = full_counts.select(*key, "state", F.col("n").cast("long").alias("n"), prob.alias("prob"))
    return out.select(
        "*",
        (F.sum("prob").over(upto) - F.col("prob")).alias("cum_lo"),
        F.sum("prob").over(upto).alias("cum_hi"),
    )


# ---- the fitted network ---------------------------------------------------
@dataclass
class ProfileNetwork:
    """Fitted structure, states, probability tables (all parent combinations, or those that occur) and bins."""

    features: list[str]
    parents: dict[str, list[str]]
    states: States
    tables: DataFrame
    edges: dict = field(default_factory=dict)
    fixed_bins: Mapping[str, tuple] = field(default_factory=lambda: vocab.FIXED_BINS)
    integer_columns: Sequence[str] = ()
    inverse_ranges: Mapping[str, Mapping] = field(default_factory=lambda: vocab.INVERSE_RANGES)

    def edge_list(self) -> list[tuple[str, str]]:
        return sorted((p, v) for v, ps in self.parents.items() for p in ps)

    def table(self, node: str) -> DataFrame:
        return self.tables.where(F.col("node") == node)

    def order(self) -> list[str]:
        """Parents before children."""
        done: list[str] = []
        while len(done) < len(self.features):
            done += [v for v in self.features if v not in done and all(p in done for p in self.parents[v])]
        return done

    def analyse_edges(self, target: str, of_interest: Sequence[str] | None = None) -> dict:
        """Edges into ``target`` and its conditional probabilities by parent state."""
        ps = [p for p in self.parents[target] if of_interest is None or p in of_interest]
        table = self.table(target).select(
            parent_text({target: sorted(self.parents[target])}).alias("parent_key"),
            F.concat_ws("=", F.lit(target), "state").alias("outcome"), "state", "prob",
        )
        return {"edges": [(p, target) for p in ps], "parents": ps, "states": self.states.of(target), "table": table}

    def described(self) -> DataFrame:
        """The tables with ``parent_key`` as text."""
        named = {v: sorted(ps) for v, ps in self.parents.items()}
        return self.tables.select("node", parent_text(named).alias("parent_key"), *[c for c in self.tables.columns if c not in ("node", "parent_states")])

    def sample_states(self, n: int, seed: int = 42, datasets: int = 1) -> DataFrame:
        """Ancestral sampling of ``n`` rows per dataset, dataset ``i`` on seed + i.

        Each node joins its own table on the parents' states and a slot of the unit interval; a probability is listed in the
        slots it reaches into, so a row meets a few of them, and a parent combination that a third of the rows have is spread
        over all its slots. Combinations that are not listed have equal shares.
        """
        out = self.tables.sparkSession.range(n).withColumnRenamed("id", "row_id").withColumn(
            "dataset_id", F.explode(F.sequence(F.lit(0), F.lit(datasets - 1)))
        )
        for v in self.order():
            r = self.states.counts[v]
            slots = max(1, math.ceil(r / SLOT_STATES))
            order = Window.partitionBy("parent_states").orderBy("state")
            table = self.table(v).select(
                F.col("parent_states").alias("__p"),
                F.col("state").alias(v),
                F.coalesce(F.lag("cum_hi").over(order), F.lit(0.0)).alias("__lo"),
                F.when(F.lead("state").over(order).isNull(), F.lit(2.0)).otherwise(F.col("cum_hi")).alias("__hi"),
            )
            slot = lambda x: F.least(F.floor(x * slots), F.lit(slots - 1))  # noqa: B023, E731
            table = table.withColumn("__slot", F.explode(F.sequence(slot(F.col("__lo")), slot(F.col("__hi")))))
            u = hash_uniform(F.lit(seed) + F.col("dataset_id"), F.col("row_id"), F.lit(v))
            rows = out.withColumn("__u", u).withColumn("__s", slot(F.col("__u"))).withColumn("__q", parent_states(sorted(self.parents[v])))
            met = (F.col("__q") == F.col("__p")) & (F.col("__s") == F.col("__slot")) & (F.col("__u") >= F.col("__lo")) & (F.col("__u") < F.col("__hi"))
            out = rows.join(table, met, "left")
            if self.parents[v]:
                even = self.states.of(v).select(F.col("at").alias("__at"), F.col("state").alias("__even"))
                at = F.when(F.col(v).isNull(), F.floor(F.col("__u") * r).cast("bigint"))
                out = out.withColumn("__i", at).join(even, F.col("__i") == F.col("__at"), "left").withColumn(v, F.coalesce(v, "__even"))
            out = out.drop("__u", "__s", "__q", "__p", "__lo", "__hi", "__slot", "__i", "__at", "__even")
        return out

    def to_values(self, sampled: DataFrame, seed: int = 0) -> DataFrame:
        """States back to values: uniform inside the bin, flags to int."""
        ranges: dict[str, dict] = {}
        defaults: dict[str, tuple] = {}
        for c in self.features:
            if c in self.fixed_bins:
                ranges[c] = dict(self.inverse_ranges[c])
                defaults[c] = vocab.INVERSE_DEFAULTS.get(c) or next(iter(ranges[c].values()))
            elif c in self.edges:
                e = self.edges[c]
                ranges[c] = {f"Q{i + 1}": (e[i], e[i + 1]) for i in range(len(e) - 1)}
                defaults[c] = (e[0], e[-1])
        out = {}
        for c in self.features:
            if c in ranges:
                lo, hi = F.lit(float(defaults[c][0])), F.lit(float(defaults[c][1]))
                for s, (a, b) in ranges[c].items():
                    lo = F.when(F.col(c) == s, F.lit(float(a))).otherwise(lo)
                    hi = F.when(F.col(c) == s, F.lit(float(b))).otherwise(hi)
                u = hash_uniform(F.lit(seed), F.col("dataset_id"), F.col("row_id"), F.lit(c), F.lit("value"))
                v = lo + (hi - lo) * u
                out[c] = F.round(v, 2) if c == "los" else v
            elif c in self.integer_columns:
                out[c] = F.col(c).cast("int")
        return sampled.withColumns(out)

    def sample(self, n: int, seed: int = 42, datasets: int = 1) -> DataFrame:
        return self.to_values(self.sample_states(n, seed, datasets))


def fit_network(
    df: DataFrame,
    features: Sequence[str] = vocab.PROFILE_FEATURES,
    quartile_columns: Sequence[str] = vocab.LAB_COLUMNS,
    fixed_bins: Mapping[str, tuple] = vocab.FIXED_BINS,
    max_indegree: int = 3,
    equivalent_sample_size: float = 10.0,
    inverse_ranges: Mapping[str, Mapping] = vocab.INVERSE_RANGES,
) -> ProfileNetwork:
    """Discretise, choose the structure, estimate the tables."""
    features = [c for c in features if c in df.columns]
    quart = [c for c in quartile_columns if c in features]
    edges = quartile_edges(df, quart) if quart else {}
    profiles = cut_lineage(distinct_profiles(discretise(df, features, edges, fixed_bins), features))
    n_rows = profiles.agg(F.sum("weight")).first()[0] or 0
    if not n_rows:
        raise ValueError("no rows to fit on")
    states = states_of(profiles, features)
    parents = learn_structure(profiles, features, states, n_rows, max_indegree)
    ordered = {v: sorted(ps) for v, ps in parents.items()}
    tables = cut_lineage(probability_tables(profiles, ordered, states, n_rows, equivalent_sample_size, full=False))
    ints = [c for c, t in df.dtypes if c in features and t in ("int", "bigint") and c not in fixed_bins and c not in quart]
    return ProfileNetwork(features, ordered, states, tables, edges, fixed_bins, ints, inverse_ranges)


def pair_static_with_series(static: DataFrame, series: DataFrame, key: str = "stay_id") -> DataFrame:
    """Static rows that have a series; an error when none do."""
    kept = static.join(series.select(key).distinct(), key, "left_semi")
    if kept.isEmpty():
        raise ValueError(f"no overlapping {key} between static rows and series")
    return kept
