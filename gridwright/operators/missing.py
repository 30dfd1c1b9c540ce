"""Repair of missing cells: one aggregate for all columns, then one projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.functions.frequencies import most_frequent
from gridwright.functions.quantiles import exact_quantiles, size_aggregates
from gridwright.functions.semantics import (
    column,
    dtype,
    is_numeric,
    is_text,
    known,
    missing,
    number,
    require_columns,
)

# The strategy names a user can choose.
AUTO = "Auto (Median/Mode)"
STRATEGIES = (AUTO, "Mean", "Median", "Mode", "Zero", "Unknown")
UNKNOWN_TEXT = "Unknown"


@dataclass(frozen=True)
class Fill:
    """Fitted fill values. ``as_double`` lists columns that turn into doubles."""

    values: dict[str, Any]
    missing_before: dict[str, int]
    as_double: frozenset[str] = field(default_factory=frozenset)

    @property
    def cells(self) -> int:
        return sum(self.missing_before.values())


def _resolve(df: DataFrame, name: str, strategy: str) -> str:
    kind = dtype(df, name)
    if strategy not in STRATEGIES:
        raise ValueError(f"No such way to fill: {strategy}.")
    if strategy == AUTO:
        return "Median" if is_numeric(kind) else "Mode"
    if strategy in ("Mean", "Median") and not is_numeric(kind):
        raise ValueError(f"{strategy} fills numeric columns only.")
    if strategy == "Unknown" and not is_text(kind):
        raise ValueError("The text Unknown fills categorical columns only.")
    if strategy == "Zero" and not (is_numeric(kind) or is_text(kind) or isinstance(kind, T.BooleanType)):
        raise ValueError(f"Zero cannot fill a column of type {kind.simpleString()}.")
    return strategy


def fit_fill(df: DataFrame, names: Sequence[str], strategy: str, fallback: str | None = None) -> Fill:
    """Find the fill value of every column.

    A column whose cells are all missing has no mean, median or mode and keeps its
    missing cells, unless ``fallback`` is given for text.
    """
    require_columns(df, names)
    plan = {n: _resolve(df, n, strategy) for n in names}
    means = [n for n in names if plan[n] == "Mean"]
    medians = [n for n in names if plan[n] == "Median"]
    counts = df.agg(
        *[F.count_if(missing(df, n)).alias(f"m{i}") for i, n in enumerate(names)],
        *[F.avg(number(df, n)).alias(f"a{i}") for i, n in enumerate(means)],
        *size_aggregates(df, medians),
    ).first()
    before = {n: counts[f"m{i}"] for i, n in enumerate(names)}
    values: dict[str, Any] = {n: counts[f"a{i}"] for i, n in enumerate(means)}
    found = exact_quantiles(df, medians, [0.5], sizes=counts)
    values.update({n: v[0] for n, v in found.items()})
    for n, top in most_frequent(df, [n for n in names if plan[n] == "Mode"]).items():
        values[n] = top.value if top else (fallback if is_text(dtype(df, n)) else None)
    for n in names:
        if plan[n] == "Zero":
            values[n] = 0 if is_numeric(dtype(df, n)) else "0" if is_text(dtype(df, n)) else False
        elif plan[n] == "Unknown":
            values[n] = UNKNOWN_TEXT
    # A mean or median need not be a whole number, so a repaired column is a double.
    widened = frozenset(n for n in names if plan[n] in ("Mean", "Median") and before[n])
    return Fill({n: values[n] for n in names}, before, widened)


def apply_fill(df: DataFrame, fill: Fill) -> DataFrame:
    """Put the fitted values in place of missing cells, in one projection."""
    out = []
    for c in df.columns:
        value = fill.values.get(c)
        if value is None:
            out.append(column(c))
            continue
        kind = T.DoubleType() if c in fill.as_double else dtype(df, c)
        filled = F.coalesce(known(df, c).cast(kind), F.lit(value).cast(kind))
        out.append(filled.alias(c))
    return df.select(*out)


def fill_missing(df: DataFrame, names: Sequence[str] | str, strategy: str = AUTO) -> DataFrame:
    """Fill one or several columns with one strategy; complete columns stay as they are."""
    names = [names] if isinstance(names, str) else list(names)
    return apply_fill(df, only_needed(fit_fill(df, names, strategy)))


def smart_fill(df: DataFrame) -> DataFrame:
    """Fill all columns: median for numbers, else mode, else the text ``Unknown``."""
    scalar = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    return apply_fill(df, only_needed(fit_fill(df, scalar, AUTO, fallback=UNKNOWN_TEXT)))


def only_needed(fill: Fill) -> Fill:
    """Leave out columns that had no missing cell."""
    return Fill({n: v for n, v in fill.values.items() if fill.missing_before[n]}, fill.missing_before, fill.as_double)
