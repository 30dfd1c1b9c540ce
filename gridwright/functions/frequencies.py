"""Most frequent values, counted with a shuffle instead of one buffer per column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.semantics import known


@dataclass(frozen=True)
class Top:
    value: Any
    count: int
    distinct: int


def stacked_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``slot, value, n``: rows per column and known value, for columns of one type.

    ``slot`` is the position of the column in ``names``. Map-side counting absorbs hot
    values, and no task holds all values of a column.
    """
    slots = [f"s{i}" for i in range(len(names))]
    plain = df.select(*[known(df, n).alias(s) for n, s in zip(names, slots)])
    stacked = plain.unpivot([], slots, "slot", "value").where(F.col("value").isNotNull())
    counts = stacked.groupBy("slot", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("slot", F.substring("slot", 2, 10).cast("int"))


def most_frequent(df: DataFrame, names: Sequence[str]) -> dict[str, Top | None]:
    """Per column the most frequent known value (the smallest on a tie)."""
    found: dict[str, Top | None] = {n: None for n in names}
    by_kind: dict[str, list[str]] = {}
    for n in names:
        by_kind.setdefault(df.schema[n].dataType.simpleString(), []).append(n)
    for same in by_kind.values():
        best = stacked_counts(df, same).groupBy("slot").agg(
            F.min(F.struct((-F.col("n")).alias("m"), F.col("value"))).alias("best"),
            F.count("*").alias("distinct"),
        )
        for row in best.collect():  # one row per column
            found[same[row["slot"]]] = Top(row["best"]["value"], -row["best"]["m"], row["distinct"])
    return found
