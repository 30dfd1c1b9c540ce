"""Dropping rows by position, by missing cells and as duplicates."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.ranks import top_rows, with_row_index
from gridwright.functions.semantics import column, known, missing, normalised, require_columns

# Neighbouring row numbers that meet the spans of a list in one bucket.
BUCKET_ROWS = 512

_PART = re.compile(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?")


def parse_row_spec(spec: str, total: int) -> list[tuple[int, int]]:
    """Turn ``"0, 5, 8-12"`` into merged, inclusive row ranges.

    Ranges stay ranges, so a spec covering billions of rows costs nothing here.
    """
    spans = []
    for part in spec.split(","):
        if not part.strip():
            continue
        match = _PART.fullmatch(part)
        if not match:
            raise ValueError(f"Not a row index or range: {part.strip()!r}")
        ends = sorted(int(g) for g in match.groups() if g is not None)
        if ends[-1] >= total:
            raise ValueError(f"Row index out of range: {max(ends[0], total)}")
        spans.append((ends[0], ends[-1]))
    merged: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if merged and low <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def drop_row_positions(df: DataFrame, spec: str, order_by: Sequence[str] = (), stable: bool = False) -> DataFrame:
    """Drop rows by their 0-based number; the numbers follow ``order_by`` if given.

    A row looks itself up among the sorted ranges by halving, so long lists cost a few steps a row.
    """
    spans = parse_row_spec(spec, df.count())
    if not spans:
        return df
    numbered = with_row_index(df, order_by, name="_row", stable=stable)
    row = F.col("_row")
    lows, highs = (
        F.split(F.lit(",".join(str(s[i]) for s in spans)), ",").cast("array<bigint>") for i in (0, 1)
    )  # constants once the plan is optimised
    before = F.lit(0)  # ranges that start at or before the row, found bit by bit
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(spans).bit_length()))])
    before = F.aggregate(
        steps, before, lambda n, step: F.when(F.get(lows, n + step - 1) <= row, n + step).otherwise(n)
    )
    inside = F.coalesce(row <= F.get(highs, F.col("_before") - 1), F.lit(False))
    return numbered.withColumn("_before", before).where(~inside).drop("_row", "_before")


def drop_rows_listed(
    df: DataFrame, spans: DataFrame, order_by: Sequence[str] = (), stable: bool = False, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Drop rows by their 0-based number, which is inside one of ``spans``: a table of any size, ``low`` and ``high``.

    Both ends count, in either order; spans may repeat and overlap. Rows and spans meet in buckets of ``bucket_rows``
    neighbouring numbers, so neither side is sent whole anywhere. A null end, or one that no row has, is an error.
    """
    total = df.count()
    ends = spans.select(F.least("low", "high").cast("long").alias("_low"), F.greatest("low", "high").cast("long").alias("_high"))
    facts = spans.agg(F.min(F.least("low", "high")), F.max(F.greatest("low", "high")), F.count_if(F.col("low").isNull() | F.col("high").isNull())).first()
    if facts[2]:
        raise ValueError("A span of rows has no end.")
    if facts[0] is None:
        return df
    if facts[0] < 0 or facts[1] >= total:
        raise ValueError(f"Row index out of range: {facts[0] if facts[0] < 0 else facts[1]}")
    bucket = lambda c: F.floor(F.col(c) / bucket_rows)
    met = ends.select("_low", "_high", F.explode(F.sequence(bucket("_low"), bucket("_high"))).alias("_bucket")).distinct()
    numbered = with_row_index(df, order_by, name="_row", stable=stable).withColumn("_bucket", bucket("_row"))
    inside = (numbered["_bucket"] == met["_bucket"]) & F.col("_row").between(F.col("_low"), F.col("_high"))
    return numbered.join(met, inside, "left_anti").drop("_row", "_bucket")


def drop_missing_rows(df: DataFrame, name: str) -> DataFrame:
    """Keep rows where the column is known."""
    require_columns(df, [name])
    return df.where(~missing(df, name))


def drop_duplicates(df: DataFrame, row: str | None = None) -> DataFrame:
    """One row of each set of equal rows; missing cells equal each other.

    With a row-number column ``row`` the first copy is kept. Copies are combined
    before the shuffle, so a row that fills a third of the table moves once per task.
    """
    df = normalised(df)
    if row is None:
        return df.dropDuplicates()
    require_columns(df, [row])
    rest = [c for c in df.columns if c != row]
    first = df.groupBy(*[column(c) for c in rest]).agg(F.min(column(row)).alias(row))
    return first.select(*[column(c) for c in df.columns])


def preview(df: DataFrame, count: int = 25, order_by: Sequence[str] = ()) -> DataFrame:
    """The first rows for a look at the table."""
    return top_rows(df, count, order_by)


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    """The known values of a column as text, each once."""
    require_columns(df, [name])
    return df.select(known(df, name).cast("string").alias(name)).na.drop().distinct()

