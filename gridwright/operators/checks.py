"""Guards that run before or after an operator."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame


def require_rows(df: DataFrame | None) -> None:
    """The table must exist and hold at least one row and one column."""
    if df is None or not df.columns or df.isEmpty():
        raise ValueError("The table is empty: it has no rows or was not loaded.")


def require_target(df: DataFrame, target: str) -> None:
    if target not in df.columns:
        raise ValueError(f"The label column '{target}' was not found.")


def checked(result, action: str) -> DataFrame:
    """Accept the result of a step only if it is a usable table.

    Names that differ only in case count as duplicates: Spark resolves names
    without regard to case. Schema checks come first, so at most one job runs.
    """
    if not isinstance(result, DataFrame):
        raise ValueError(f"{action} gave something that is not a DataFrame.")
    if not result.columns:
        raise ValueError(f"{action} takes away all columns.")
    seen = Counter(c.lower() for c in result.columns)
    repeated = [c for c in result.columns if seen[c.lower()] > 1]
    if repeated:
        raise ValueError(f"{action} gives duplicate columns: {repeated[:5]}.")
    if result.isEmpty():
        raise ValueError(f"{action} keeps 0 rows.")
    return result
