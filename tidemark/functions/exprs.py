"""Scalar column expressions: everything here stays inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns read off the schema (no data scan), minus ids."""
    skip = set(exclude)
    return [c for c, t in df.dtypes if t.split("(")[0] in NUMERIC_TYPES and c not in skip]


# ---- predicates -----------------------------------------------------------
def code_match(
    code: str | Column,
    version: str | Column | None,
    prefixes: Mapping[int, Sequence[str]],
    exact: Mapping[int, Sequence[str]] | None = None,
) -> Column:
    """Version-guarded code predicate: prefix matches plus exact codes."""
    code = _col(code)
    parts = []
    for v in sorted(set(prefixes) | set(exact or {})):
        hit = any_of(code.startswith(p) for p in prefixes.get(v, []))
        if exact and exact.get(v):
            hit = hit | code.isin(list(exact[v]))
        parts.append(hit if version is None else (_col(version) == v) & hit)
    return any_of(parts)


def text_match(text: str | Column, terms: Sequence[str]) -> Column:
    """True when the lower-cased text contains any of the terms."""
    low = F.lower(_col(text))
    return any_of(low.contains(t) for t in terms)


def code_ladder(
    code: str | Column, version: str | Column, ladder: Sequence[tuple], default: str
) -> Column:
    """Ordered classification by code prefix; first rung that matches wins."""
    out = None
    for prefix, v, label in ladder:
        cond = _col(code).startswith(prefix)
        if v is not None:
            cond = (_col(version) == v) & cond
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default)


def text_ladder(text: str | Column, ladder: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    out = None
    for label, terms in ladder:
        cond = text_match(text, terms)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default)


# ---- parsing --------------------------------------------------------------
def parse_with_sentinel(text: str | Column, sentinel: str = "> 89", value: int = 90) -> Column:
    """Integer parse of dirty text where one sentinel stands for a number."""
    text = _col(text)
    return F.when(text == sentinel, F.lit(value)).otherwise(text.try_cast("int"))


def number_or_leading_digits(number: str | Column, text: str | Column) -> Column:
    """The numeric value, else the leading digits of the text, else NULL."""
    text = _col(text)
    lead = F.regexp_extract(text, r"^(\d+)", 1)
    return F.coalesce(
        _col(number).cast("double"), F.when(text.rlike(r"^\d+"), lead.cast("double"))
    )


def flag_equals(text: str | Column, label: str) -> Column:
    """0/1 flag of a case-insensitive label; NULL counts as 0."""
    return F.coalesce(F.lower(_col(text)) == label, F.lit(False)).cast("int")


def map_values(c: str | Column, mapping: Mapping[str, str]) -> Column:
    """Value mapping that falls through to the original value."""
    c = _col(c)
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(c)


# ---- time -----------------------------------------------------------------
def micros(ts: str | Column) -> Column:
    return F.unix_micros(_col(ts).cast("timestamp"))


def hour_since(ts: str | Column, start: str | Column) -> Column:
    """Whole hours from ``start`` to ``ts``, floored (so −1 for the hour before)."""
    return F.floor((micros(ts) - micros(start)) / F.lit(3_600_000_000)).cast("int")


def hour_of_offset(minutes: str | Column) -> Column:
    return F.floor(_col(minutes) / F.lit(60)).cast("int")


# ---- arithmetic -----------------------------------------------------------
def fahrenheit_to_celsius(f: str | Column) -> Column:
    return (_col(f) - F.lit(32.0)) * F.lit(5.0) / F.lit(9.0)


def celsius_guarded(t: str | Column, threshold: float = 50.0) -> Column:
    """Readings above the threshold are taken as Fahrenheit."""
    t = _col(t)
    return F.when(t > threshold, fahrenheit_to_celsius(t)).otherwise(t)


def strict_sum(*cols: str | Column) -> Column:
    """Sum that is NULL as soon as one part is NULL."""
    return reduce(lambda a, b: a + b, [_col(c) for c in cols])


def clip(c: str | Column, lo: float, hi: float) -> Column:
    """Clip that keeps NULL (``least``/``greatest`` alone would skip it)."""
    c = _col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)).cast("double"))


def round_scaled(c: str | Column, digits: int) -> Column:
    """Round by scaling up, rounding to a whole number and scaling down, as
    column engines do: 9.825 is stored below the tie and goes to 9.82."""
    unit = F.lit(float(10**digits))
    return F.round(_col(c) * unit) / unit


def scale_to_unit(c: str | Column, lo: float, hi: float) -> Column:
    """Min-max scale to [−1, 1]; a constant column stays as it is."""
    c = _col(c).cast("double")
    return F.lit(2.0) * (c - F.lit(lo)) / F.lit(hi - lo) - F.lit(1.0) if hi > lo else c


def unscale_from_unit(c: str | Column, lo: float, hi: float) -> Column:
    """Inverse of :func:`scale_to_unit`; a constant column becomes its constant."""
    if hi > lo:
        return (_col(c) + F.lit(1.0)) / F.lit(2.0) * F.lit(float(hi - lo)) + F.lit(float(lo))
    return F.lit(float(lo))


def bin_label(
    c: str | Column, edges: Sequence[float], labels: Sequence[str], right_closed: bool = False,
    include_lowest: bool = False,
) -> Column:
    """Fixed-edge binning to labels. Left-closed ``[a, b)`` by default; values
    outside all bins become NULL."""
    c = _col(c)
    out = None
    for i, label in enumerate(labels):
        lo, hi = F.lit(float(edges[i])), F.lit(float(edges[i + 1]))
        if right_closed:
            cond = ((c >= lo) if include_lowest and i == 0 else (c > lo)) & (c <= hi)
        else:
            cond = (c >= lo) & (c < hi)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


# ---- reproducible pseudo-randomness --------------------------------------
def hash_uniform(*parts: str | int | Column) -> Column:
    """A uniform number in [0, 1) from md5 of the parts: the same on every run,
    whatever the partitioning (``rand(seed)`` is not)."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def map_override(base: str | Column, overrides: str | Column) -> Column:
    """Merge two maps, the second winning on shared keys."""
    base, overrides = _col(base), _col(overrides)
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(overrides, k))
    return F.map_concat(kept, overrides)
