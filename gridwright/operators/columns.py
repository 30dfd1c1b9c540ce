"""Choosing, dropping, renaming and converting columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.semantics import (
    categorical_columns,
    column,
    dtype,
    is_text,
    missing,
    numeric_columns,
    require_columns,
)
from gridwright.operators.checks import require_target


def search_columns(df: DataFrame, query: str = "") -> DataFrame:
    """Columns whose name contains the text, in any case; an empty text keeps all."""
    return df.select(*[column(c) for c in df.columns if query.lower() in c.lower()])


def columns_of_class(df: DataFrame, kind: str) -> DataFrame:
    """All ``numeric`` or all ``categorical`` columns."""
    pick = {"numeric": numeric_columns, "categorical": categorical_columns}
    if kind not in pick:
        raise ValueError(f"Unknown column class: {kind}")
    return df.select(*[column(c) for c in pick[kind](df)])


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns that must all exist."""
    require_columns(df, names)
    return drop_existing(df, names)


def drop_existing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop those of the named columns that exist."""
    return df.select(*[column(c) for c in df.columns if c not in set(names)])


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename one column; the new name is stripped and must be free."""
    new = new.strip()
    if old not in df.columns:
        raise ValueError("There is no column to rename: it is gone.")
    if not new:
        raise ValueError("A column needs a name that is not empty.")
    if new != old and new.lower() in {c.lower() for c in df.columns if c != old}:
        raise ValueError("A column of that name exists.")
    return df.select(*[column(c).alias(new if c == old else c) for c in df.columns])


def to_number(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Convert to double; text that is no number becomes missing."""
    require_columns(df, names)
    out = []
    for c in df.columns:
        if c not in names:
            out.append(column(c))
        elif is_text(dtype(df, c)):
            value = column(c).try_cast("double")
            out.append(F.nanvl(value, F.lit(None).cast("double")).alias(c))
        else:
            out.append(column(c).cast("double").alias(c))
    return df.select(*out)


def features_and_label(df: DataFrame, target: str) -> list[str]:
    """Names of the feature columns, after checking the label is complete."""
    require_target(df, target)
    features = [c for c in df.columns if c != target]
    if not features:
        raise ValueError("No features are left beside the label.")
    if not df.where(missing(df, target)).isEmpty():
        raise ValueError("The label has missing values; fill them or drop their rows.")
    return features
