"""Fit-on-train feature preparation: impute, encode, scale, bin, split.

``fit_*`` runs one aggregation over the training rows and brings back a few
numbers per column; ``apply_*`` turns them into literals, so applying never
shuffles and stays in code generation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions.exprs import (
    bin_label,
    numeric_columns,
    scale_to_unit,
    unscale_from_unit,
)
from tidemark.operators.skew import hash_cuts, null_safe_join, quantiles, upto_cut
from tidemark.session import cut_lineage



def is_lab(column: str) -> bool:
    return column.startswith("lab_") or column.endswith("_admit")


# ---- imputation -----------------------------------------------------------
def fit_imputation(train: DataFrame, method: str = "median", exclude: Sequence[str] = ()) -> dict:
    """Fill values for every numeric and text column of the training rows.

    Numeric: median or mean. Text: most frequent value, ties by value order.
    """
    if method not in ("median", "mean"):
        raise ValueError(f"impute by median or mean, not by {method!r}")
    numeric = numeric_columns(train, exclude)
    text = [c for c, t in train.dtypes if t == "string" and c not in exclude]
    fills: dict = {}
    if numeric and method == "mean":
        row = train.agg(*[F.avg(c).alias(c) for c in numeric]).first()
        fills.update({c: row[c] for c in numeric if row[c] is not None})
    elif numeric:
        for r in quantiles(train, numeric, [0.5]).select("variable", "q0").collect():
            fills[r["variable"]] = r["q0"]
    if text:
        fills.update(modes(train, text))
    return fills


def category_counts(df: DataFrame, cols: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """(group..., variable, category, n) for several columns in one scan."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("category")) for c in cols]
    )
    return (
        df.select(*group, F.explode(entries).alias("e"))
        .select(*group, "e.*")
        .groupBy(*group, "variable", "category")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """Most frequent non-NULL value per column; ties go to the smallest value."""
    counts = category_counts(df, cols).where(F.col("category").isNotNull())
    best = counts.groupBy("variable").agg(
        F.min_by("category", F.struct(-F.col("n"), F.col("category"))).alias("mode")
    )
    return {r["variable"]: r["mode"] for r in best.collect()}


def apply_imputation(df: DataFrame, fills: Mapping[str, object], flag_labs: bool = True) -> DataFrame:
    """Fill NULLs from fitted values; lab columns also get a ``_missing`` flag."""
    types = dict(df.dtypes)
    out = []
    for c in df.columns:
        if c not in fills:
            out.append(F.col(c))
        elif types[c] == "string":
            out.append(F.coalesce(F.col(c), F.lit(fills[c])).alias(c))
        else:
            fill = float(fills[c])
            whole = types[c] in ("int", "bigint", "smallint", "tinyint") and fill == int(fill)
            kind = types[c] if whole else "double"
            out.append(F.coalesce(F.col(c).cast(kind), F.lit(fill).cast(kind)).alias(c))
    if flag_labs:
        out += [F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in df.columns if is_lab(c)]
    return df.select(*out)


def impute(df: DataFrame, method: str = "median") -> DataFrame:
    """Fit and apply on the same rows."""
    return apply_imputation(df, fit_imputation(df, method))


# ---- one-hot --------------------------------------------------------------
def fit_categories(train: DataFrame, cols: Sequence[str] = vocab.CATEGORICAL_COLUMNS) -> dict[str, list[str]]:
    """Distinct non-NULL values per categorical column, sorted: the names of the columns that ``one_hot`` makes.

    The driver holds them as it holds column names. For columns of very many values see ``category_index``.
    """
    present = [c for c in cols if c in train.columns]
    cats: dict[str, list[str]] = {c: [] for c in present}
    if present:
        for r in category_counts(train, present).where(F.col("category").isNotNull()).select("variable", "category").collect():
            cats[r["variable"]].append(r["category"])
    return {c: sorted(v) for c, v in cats.items()}


def category_index(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``variable, category, at``: a written table of all non-NULL values, numbered from 0 without gaps in their order.

    Values are sorted by range over all tasks; numbers start at what the ranges before hold. Nothing reaches the driver.
    """
    values = category_counts(train, cols).where(F.col("category").isNotNull()).select("variable", "category")
    ranged = cut_lineage(values.repartitionByRange("variable", "category").withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    inside = Window.partitionBy("__part").orderBy("variable", "category")
    numbered = ranged.withColumn("__i", F.row_number().over(inside) - 1).join(offsets, "__part")
    return cut_lineage(numbered.select("variable", "category", (F.col("__from") + F.col("__i")).cast("bigint").alias("at")))


def sparse_indicators(df: DataFrame, index: DataFrame, cols: Sequence[str], out: str = "hot") -> DataFrame:
    """Replace ``cols`` by one array with the place of each column's 1 in the row of all indicators, NULL where there is none.

    The index is unique by value, so a value that owns a third of the rows is split by a skew join.
    """
    for i, c in enumerate(cols):
        own = index.where(F.col("variable") == c).select(F.col("category").alias("__category"), F.col("at").alias(f"__at{i}"))
        df = df.join(own, F.col(c).cast("string") == F.col("__category"), "left").drop("__category")
    made = df.withColumn(out, F.array(*[F.col(f"__at{i}") for i in range(len(cols))]))
    return made.drop(*cols, *[f"__at{i}" for i in range(len(cols))])


def from_indicators(df: DataFrame, index: DataFrame, cols: Sequence[str], hot: str = "hot") -> DataFrame:
    """The inverse of ``sparse_indicators``: text columns again, NULL where no indicator is set."""
    for i, c in enumerate(cols):
        own = index.where(F.col("variable") == c).select(F.col("category").alias(c), F.col("at").alias("__at"))
        df = df.join(own, F.get(hot, F.lit(i)) == F.col("__at"), "left").drop("__at")
    return df.drop(hot)


def indicator_vectors(df: DataFrame, width: int, n_cols: int, hot: str = "hot", out: str = "features") -> DataFrame:
    """The indicators as one sparse vector of ``pyspark.ml``; ``width``: rows of the index."""
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler

    places = [f"__p{i}" for i in range(n_cols)]
    df = df.withColumns({p: F.coalesce(F.get(hot, F.lit(i)), F.lit(width)).cast("double") for i, p in enumerate(places)})
    wide = df.sparkSession.range(width + 1).select(*[F.col("id").cast("double").alias(p) for p in places])
    model = OneHotEncoder(inputCols=places, outputCols=[f"{p}v" for p in places], dropLast=True).fit(wide)
    made = VectorAssembler(inputCols=[f"{p}v" for p in places], outputCol=out).transform(model.transform(df))
    return made.drop(*places, *[f"{p}v" for p in places])


def one_hot(df: DataFrame, categories: Mapping[str, Sequence[str]]) -> DataFrame:
    """Replace each column by 0/1 columns ``col_value``."""
    drop = [c for c in categories if c in df.columns]
    flags = [
        F.coalesce(F.col(c).cast("string") == v, F.lit(False)).cast("int").alias(f"{c}_{v}")
        for c in drop
        for v in categories[c]
    ]
    return df.select(*[F.col(c) for c in df.columns if c not in drop], *flags)


def reverse_one_hot(df: DataFrame, prefix: str, values: Sequence[str], default: str) -> Column:
    """Label of the largest indicator; first listed wins ties; ``default`` when absent."""
    present = [v for v in values if f"{prefix}{v}" in df.columns]
    if not present:
        return F.lit(default)
    cols = [F.col(f"`{prefix}{v}`") for v in present]
    top = F.greatest(*cols) if len(cols) > 1 else cols[0]
    out = None
    for v, c in zip(present, cols):
        out = F.when(c == top, v) if out is None else out.when(c == top, v)
    return out


def align_columns(*frames: DataFrame, fill: float = 0) -> list[DataFrame]:
    """Give all frames the union of their columns, missing ones filled, sorted."""
    types: dict[str, str] = {}
    for f in frames:
        for c, t in f.dtypes:
            types.setdefault(c, t)
    names = sorted(types)
    return [
        f.select(*[F.col(f"`{c}`") if c in f.columns else F.lit(fill).cast(types[c]).alias(c) for c in names])
        for f in frames
    ]


def conform(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Fixed column order; columns that are absent become typed NULLs."""
    return df.select(
        *[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in schema.items()]
    )


def coerce_numeric_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text columns whose every value parses become numeric; others stay text."""
    if not cols:
        return df
    bad = df.agg(
        *[
            F.sum((F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).cast("long")).alias(c)
            for c in cols
        ]
    ).first()
    return df.withColumns({c: F.col(c).cast("double") for c in cols if not bad[c]})


# ---- scaling --------------------------------------------------------------
def fit_minmax(train: DataFrame, cols: Sequence[str]) -> dict[str, dict[str, float]]:
    """``{column: {min, max}}`` from one aggregation."""
    if not cols:
        return {}
    row = train.agg(
        *[F.min(F.col(f"`{c}`").cast("double")).alias(f"{i}_lo") for i, c in enumerate(cols)],
        *[F.max(F.col(f"`{c}`").cast("double")).alias(f"{i}_hi") for i, c in enumerate(cols)],
    ).first()
    return {
        c: {"min": row[f"{i}_lo"], "max": row[f"{i}_hi"]}
        for i, c in enumerate(cols)
        if row[f"{i}_lo"] is not None
    }


def apply_minmax(df: DataFrame, params: Mapping[str, Mapping[str, float]]) -> DataFrame:
    return df.withColumns(
        {c: scale_to_unit(f"`{c}`", p["min"], p["max"]) for c, p in params.items() if c in df.columns}
    )


def invert_minmax(df: DataFrame, params: Mapping[str, Mapping[str, float]]) -> DataFrame:
    return df.withColumns(
        {c: unscale_from_unit(f"`{c}`", p["min"], p["max"]) for c, p in params.items() if c in df.columns}
    )


def fit_standard(train: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """``{column: (mean, population std)}`` with NULL read as 0."""
    filled = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    row = filled.agg(
        *[F.avg(c).alias(f"{c}__m") for c in cols], *[F.stddev_pop(c).alias(f"{c}__s") for c in cols]
    ).first()
    return {c: (row[f"{c}__m"] or 0.0, row[f"{c}__s"] or 0.0) for c in cols}


def apply_standard(df: DataFrame, params: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Standardise with fitted moments; a zero spread divides by 1."""
    return df.withColumns(
        {
            c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(float(m))) / F.lit(float(s) or 1.0)
            for c, (m, s) in params.items()
        }
    )


def z_scores(df: DataFrame, cols: Sequence[str], epsilon: float = 1e-8) -> DataFrame:
    """(x − mean) / (population std + ε) over non-NULL values; NULL becomes 0."""
    row = df.agg(
        *[F.avg(c).alias(f"{c}__m") for c in cols], *[F.stddev_pop(c).alias(f"{c}__s") for c in cols]
    ).first()
    return df.withColumns(
        {
            c: F.coalesce(
                (F.col(c) - F.lit(row[f"{c}__m"])) / F.lit((row[f"{c}__s"] or 0.0) + epsilon), F.lit(0.0)
            )
            for c in cols
        }
    )


# ---- binning --------------------------------------------------------------
def quartile_edges(df: DataFrame, cols: Sequence[str]) -> dict[str, list[float]]:
    """Quartile edges with repeats dropped; equal-width bins when all agree.
    NULLs are first filled with the median, as the bins are used on filled data."""
    med = {r["variable"]: r["q0"] for r in quantiles(df, cols, [0.5]).collect()}
    filled = df.select(
        *[F.coalesce(F.col(c).cast("double"), F.lit(med.get(c))).alias(c) for c in cols if c in med]
    )
    out = {}
    for r in quantiles(filled, list(med), [0.0, 0.25, 0.5, 0.75, 1.0]).collect():
        edges = sorted({r[f"q{i}"] for i in range(5)})
        if len(edges) < 2:
            v = edges[0]
            half = abs(v) * 0.001 if v else 0.001
            edges = [v - half + half * i / 2 for i in range(5)]
        out[r["variable"]] = edges
    return {c: out[c] for c in cols if c in out} | {f"{c}__fill": med[c] for c in med}


def quartile_label(c: str, edges: Sequence[float], fill: float) -> Column:
    labels = [f"Q{i + 1}" for i in range(len(edges) - 1)]
    value = F.coalesce(F.col(c).cast("double"), F.lit(float(fill)))
    return bin_label(value, edges, labels, right_closed=True, include_lowest=True)


# ---- splits and samples ---------------------------------------------------
def stratified_split(
    df: DataFrame,
    ids: Sequence[str],
    stratum: str | None,
    test_size: float = 0.2,
    val_size: float = 0.1,
    seed: int = 42,
) -> DataFrame:
    """Add ``split`` (train / val / test), exact shares inside every stratum.

    Rows are ranked by a hash of seed and id, so the split does not depend on
    partitioning or row order.
    """
    strata = [stratum] if stratum and stratum in df.columns else []

    def sizes(rows: Column) -> list[Column]:
        n_test = F.round(rows * F.lit(test_size))
        return [n_test, n_test + F.round((rows - n_test) * F.lit(val_size / (1 - test_size)))]

    cuts = hash_cuts(df, ids, seed, strata, sizes)
    label = F.when(upto_cut("cut0", ids, seed), "test").when(upto_cut("cut1", ids, seed), "val").otherwise("train")
    return _with_cuts(df, cuts, strata).withColumn("split", label).select(*df.columns, "split")


def random_sample(df: DataFrame, ids: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, reproducible."""
    cuts = hash_cuts(df, ids, seed, [], lambda rows: [F.least(rows, F.lit(n))])
    return _with_cuts(df, cuts, []).where(upto_cut("cut0", ids, seed)).select(*df.columns)


def _with_cuts(df: DataFrame, cuts: DataFrame, strata: Sequence[str]) -> DataFrame:
    """The cuts of its stratum on each row; without strata they are one row, which becomes literals."""
    if strata:
        return null_safe_join(df, cuts, strata, "left")
    row = cuts.first()
    kinds = {f.name: f.dataType for f in cuts.schema.fields}
    return df.withColumns({c: _literal(None if row is None else row[c], kinds[c]) for c in cuts.columns})


def _literal(value, kind) -> Column:
    """A row as a struct of literals."""
    if value is None:
        return F.lit(None).cast(kind)
    return F.struct(*[F.lit(value[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])


def head_sample(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows in a stated order (a top-n plan, no full sort)."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(n)


def tail_sample(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(n)
