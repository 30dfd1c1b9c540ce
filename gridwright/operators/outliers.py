"""Outliers by the interquartile range, and presence flags."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.constants import OUTLIER_POINTS
from gridwright.functions.quantiles import exact_quantiles
from gridwright.functions.ranks import seeded_sample
from gridwright.functions.semantics import (
    NON_BLANK,
    column,
    dtype,
    is_text,
    known,
    missing,
    number,
    require_columns,
    require_numeric,
)

DEFAULT_FACTOR = 1.5


@dataclass(frozen=True)
class Bounds:
    q1: float
    q3: float
    lower: float
    upper: float


def fit_bounds(df: DataFrame, names: Sequence[str], factor: float = DEFAULT_FACTOR) -> dict[str, Bounds]:
    """Quartiles and clip bounds of all columns at once; all-missing columns are left out."""
    require_numeric(df, names, "IQR")
    bounds = {}
    for name, (q1, q3) in exact_quantiles(df, names, [0.25, 0.75]).items():
        if q1 is not None:
            reach = factor * (q3 - q1)
            bounds[name] = Bounds(q1, q3, q1 - reach, q3 + reach)
    return bounds


def bounds_table(df: DataFrame, names: Sequence[str], factor: float = DEFAULT_FACTOR) -> DataFrame:
    """One row per column: quartiles, range and bounds."""
    rows = [(n, b.q1, b.q3, b.q3 - b.q1, b.lower, b.upper) for n, b in fit_bounds(df, names, factor).items()]
    return df.sparkSession.createDataFrame(
        rows, "column string, q1 double, q3 double, iqr double, lower double, upper double"
    )


def apply_clip(df: DataFrame, bounds: dict[str, Bounds]) -> DataFrame:
    """Limit values to their bounds; missing cells stay missing."""
    out = []
    for c in df.columns:
        if c in bounds:
            value = number(df, c)
            limited = F.least(F.greatest(value, F.lit(bounds[c].lower)), F.lit(bounds[c].upper))
            out.append(F.when(value.isNotNull(), limited).alias(c))
        else:
            out.append(column(c))
    return df.select(*out)


def clip_outliers(df: DataFrame, names: Sequence[str] | str, factor: float = DEFAULT_FACTOR) -> DataFrame:
    """Clip one or several columns; the clipped columns become doubles."""
    names = [names] if isinstance(names, str) else list(names)
    return apply_clip(df, fit_bounds(df, names, factor))


def outside(df: DataFrame, name: str, bounds: Bounds) -> Column:
    """True strictly outside the bounds, false for missing cells."""
    value = number(df, name)
    return F.coalesce((value < bounds.lower) | (value > bounds.upper), F.lit(False))


def outlier_counts(df: DataFrame, names: Sequence[str], factor: float = DEFAULT_FACTOR) -> DataFrame:
    """Per column: known values, how many would be clipped and how many kept."""
    bounds = fit_bounds(df, names, factor)
    if not bounds:
        raise ValueError("No numeric values are known here.")
    slots = {f"c{i}": n for i, n in enumerate(bounds)}
    pairs = [
        F.struct(
            F.lit(n).alias("column"),
            F.count(known(df, n)).alias("numeric_rows"),
            F.count_if(outside(df, n, bounds[n])).alias("will_clip"),
        ).alias(s)
        for s, n in slots.items()
    ]
    stacked = df.agg(*pairs).select(F.inline(F.array(*slots)))
    return stacked.withColumn("will_keep", F.col("numeric_rows") - F.col("will_clip"))


def outlier_labels(
    df: DataFrame, name: str, key: Sequence[str], factor: float = DEFAULT_FACTOR, limit: int = OUTLIER_POINTS
) -> DataFrame:
    """Key, value and ``Will clip`` or ``Keep`` for a chart: a seeded sample, in key order."""
    bounds = fit_bounds(df, [name], factor)
    if name not in bounds:
        raise ValueError("No numeric values are known here.")
    status = F.when(outside(df, name, bounds[name]), "Will clip").otherwise("Keep")
    points = df.where(~missing(df, name)).select(
        *[column(c) for c in key], number(df, name).alias("value"), status.alias("status")
    )
    return seeded_sample(points, limit, key).orderBy(*[column(c) for c in key])


def presence_flag(df: DataFrame, source: str, new: str | None = None) -> DataFrame:
    """Add a 0/1 column: 1 where the source is known and, for text, not blank."""
    require_columns(df, [source])
    new = f"Has{source.replace(' ', '')}" if new is None else new.strip()
    if not new:
        raise ValueError("A flag needs a name that is not empty.")
    if new.lower() in {c.lower() for c in df.columns}:
        raise ValueError("A column of that name exists.")
    present = ~missing(df, source)
    if is_text(dtype(df, source)):
        present = present & column(source).rlike(NON_BLANK)
    return df.select("*", F.when(present, 1).otherwise(0).alias(new))
