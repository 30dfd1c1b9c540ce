"""Table and column profiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.constants import CARDINALITY_THRESHOLD, CLASSIFICATION, FOLDS, REGRESSION
from gridwright.functions.frequencies import most_frequent
from gridwright.functions.quantiles import exact_quantiles, size_aggregates
from gridwright.functions.semantics import (
    column,
    categorical_columns,
    is_numeric,
    is_text,
    known,
    missing,
    number,
    numeric_columns,
    require_columns,
    row_hash,
)
from gridwright.operators.checks import require_target


def _missing_cells(df: DataFrame) -> Column:
    total = F.lit(0).cast("bigint")
    for c in df.columns:
        total = total + F.count_if(missing(df, c))
    return total


def workspace_counters(df: DataFrame) -> DataFrame:
    """Rows, columns and missing cells; no shuffle beyond one row per task."""
    return df.agg(
        F.count("*").alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("cols"),
        _missing_cells(df).alias("missing"),
    )


def dataset_stats(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and duplicate rows (beyond the first of each).

    Rows are told apart by 128 bits of hash, so a row of any width is shuffled as two numbers, and equal rows are
    combined on the map side with their count and missing cells. One pass serves all four numbers. Two different rows
    of n would be taken for equal with a chance of n^2 / 2^129.
    """
    cells = F.lit(0)
    for c in df.columns:
        cells = cells + missing(df, c).cast("int")
    distinct = (
        df.select(row_hash(df, 1).alias("a"), row_hash(df, 2).alias("b"), cells.alias("cells"))
        .groupBy("a", "b").agg(F.count("*").alias("copies"), F.sum("cells").alias("cells"))
    )
    return distinct.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("cols"),
        F.coalesce(F.sum("cells"), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"),
    )


def stats_delta(current: DataFrame, base: DataFrame) -> DataFrame:
    """Current statistics minus the statistics at load."""
    names = ["rows", "cols", "missing", "duplicates"]
    # One row each: the sign turns the difference into a sum.
    signed = (
        dataset_stats(current)
        .withColumn("sign", F.lit(1))
        .unionByName(dataset_stats(base).withColumn("sign", F.lit(-1)))
    )
    return signed.agg(*[F.sum(F.col(n) * F.col("sign")).alias(n) for n in names])


def missing_by_column(df: DataFrame, top: int = 15) -> DataFrame:
    """Missing cells per column, most first: one aggregate, turned into rows."""
    slots = [f"m{i}" for i in range(len(df.columns))]
    counts = df.agg(
        *[
            F.struct(F.lit(c).alias("column"), F.count_if(missing(df, c)).alias("missing")).alias(s)
            for s, c in zip(slots, df.columns)
        ]
    )
    return counts.select(F.inline(F.array(*slots))).orderBy(F.desc("missing"), "column").limit(top)


DESCRIBE_SCHEMA = (
    "column string, count bigint, unique bigint, top string, freq bigint, mean double, std double, "
    "min double, p25 double, p50 double, p75 double, max double"
)


def describe(df: DataFrame) -> DataFrame:
    """One row per column: counts and top value for text, moments and quartiles for numbers.

    Dates and times are described like numbers, as seconds since 1970 in UTC; of nested columns only the
    count is given.
    """
    names = df.columns
    dates = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    df = df.withColumns({n: _seconds(df, n) for n in dates}) if dates else df
    numbers = [n for n in names if n in set(numeric_columns(df))]
    texts = [n for n in names if n in set(categorical_columns(df))]
    row = df.agg(
        *[F.count(known(df, n)).alias(f"n{i}") for i, n in enumerate(names)],
        *[
            f(number(df, n)).alias(f"{tag}{i}")
            for i, n in enumerate(names)
            if n in numbers
            for tag, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
        ],
        *size_aggregates(df, numbers),
    ).first()
    quartiles = exact_quantiles(df, numbers, [0.25, 0.5, 0.75], sizes=row)
    tops = most_frequent(df, texts)
    out = []
    for i, n in enumerate(names):
        if n in numbers:
            out.append(
                (n, row[f"n{i}"], None, None, None, row[f"mean{i}"], row[f"std{i}"], row[f"min{i}"])
                + tuple(quartiles[n])
                + (row[f"max{i}"],)
            )
        elif n in texts and tops[n]:
            out.append((n, row[f"n{i}"], tops[n].distinct, _shown(tops[n].value), tops[n].count) + (None,) * 7)
        else:
            out.append((n, row[f"n{i}"]) + (None,) * 10)
    return df.sparkSession.createDataFrame(out, DESCRIBE_SCHEMA)


def _seconds(df: DataFrame, name: str):
    """A date or time as seconds since 1970."""
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return F.unix_micros(column(name)) / 1e6
    moment = column(name).cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), moment) / 1e6


def _shown(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def value_counts(df: DataFrame, name: str, top: int = 10) -> DataFrame:
    """Rows per text form of the value, most first; missing cells show as ``nan``."""
    require_columns(df, [name])
    shown = F.coalesce(known(df, name).cast("string"), F.lit("nan")).alias("value")
    return (
        df.select(shown).groupBy("value").agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "value").limit(top)
    )


def task_types(df: DataFrame, targets: Sequence[str]) -> dict[str, str]:
    """Classification for text or fewer than 10 distinct known values, else regression.

    An approximate count sorts out columns with many values; the few that are near
    the threshold are counted exactly, which is then a tiny shuffle. An estimate
    above 50 cannot come from fewer than 10 values.
    """
    require_columns(df, targets)
    found = {t: CLASSIFICATION for t in targets if is_text(df.schema[t].dataType)}
    rest = [t for t in targets if t not in found]
    if rest:
        rough = df.agg(*[F.approx_count_distinct(known(df, t)).alias(f"d{i}") for i, t in enumerate(rest)]).first()
        near = [t for i, t in enumerate(rest) if rough[f"d{i}"] <= 5 * CARDINALITY_THRESHOLD]
        found.update({t: REGRESSION for t in rest if t not in near})
        if near:
            exact = df.agg(*[F.count_distinct(known(df, t)).alias(f"d{i}") for i, t in enumerate(near)]).first()
            for i, t in enumerate(near):
                found[t] = CLASSIFICATION if exact[f"d{i}"] < CARDINALITY_THRESHOLD else REGRESSION
    return found


def detect_task(df: DataFrame, target: str) -> str:
    require_target(df, target)
    return task_types(df, [target])[target]


def is_unchanged(new: DataFrame, old: DataFrame) -> bool:
    """Whether two tables hold the same rows, in any order.

    Row count and a sum of row hashes settle almost every change in one scan; only
    when they agree are the rows themselves compared.
    """
    if [(f.name, f.dataType) for f in new.schema.fields] != [(f.name, f.dataType) for f in old.schema.fields]:
        return False
    new, old = (d.toDF(*[f"c{i}" for i in range(len(d.columns))]) for d in (new, old))

    def mark(df: DataFrame):
        one = F.xxhash64(*df.columns).cast("decimal(38,0)")
        return df.agg(F.count("*"), F.sum(one)).first()

    if mark(new) != mark(old):
        return False
    signed = new.withColumn("sign", F.lit(1)).unionByName(old.withColumn("sign", F.lit(-1)))
    balance = signed.groupBy(*new.columns).agg(F.sum("sign").alias("sign"))
    return balance.where("sign <> 0").isEmpty()


@dataclass(frozen=True)
class TableMark:
    """What stands for a version of a table: columns, rows, 128 bits of contents, and the rows' order."""

    columns: tuple
    rows: int
    contents: tuple[int, int]
    order: int
    sorted: bool

    def same(self, before: TableMark) -> bool:
        """Whether this version, made from ``before``, equals it. Order counts where this version's plan sorts."""
        alike = (self.columns, self.rows, self.contents) == (before.columns, before.rows, before.contents)
        return alike and (not self.sorted or self.order == before.order)


def table_mark(df: DataFrame) -> TableMark:
    """One scan of ``df``, one row of sums per partition.

    Contents are sums of two hashes of each row. The order's mark sums each row's hash times its position; positions
    are numbered inside partitions, and the partitions' sums are shifted by the rows before them.
    """
    kinds = tuple((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    is_sorted = not df._jdf.queryExecution().optimizedPlan().outputOrdering().isEmpty()
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    marked = df.select(
        F.spark_partition_id().alias("part"), at.cast("decimal(11,0)").alias("at"), row_hash(df, 1).cast("decimal(20,0)").alias("a"),
        row_hash(df, 2).cast("decimal(20,0)").alias("b"), F.shiftright(row_hash(df, 3), 24).cast("decimal(13,0)").alias("c"),
    )
    parts = marked.groupBy("part").agg(
        F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c"), F.sum(F.col("c") * F.col("at")).alias("w")
    ).orderBy("part").collect()
    before = order = 0
    for r in parts:
        order += int(r.w) + before * int(r.c)
        before += r.n
    return TableMark(kinds, before, (sum(int(r.a) for r in parts), sum(int(r.b) for r in parts)), order, is_sorted)


def default_features(df: DataFrame, names: Sequence[str] | None = None) -> dict[str, float | str]:
    """A safe value per column: the mean for numbers (0.0 if all missing), the mode as text (or "")."""
    names = list(names if names is not None else df.columns)
    require_columns(df, names)
    numbers = [n for n in names if is_numeric(df.schema[n].dataType)]
    others = [n for n in names if n not in numbers]
    found: dict[str, float | str] = {}
    if numbers:
        row = df.agg(*[F.coalesce(F.avg(number(df, n)), F.lit(0.0)).alias(f"a{i}") for i, n in enumerate(numbers)]).first()
        found.update({n: row[f"a{i}"] for i, n in enumerate(numbers)})
    as_text = df.select(*[known(df, n).cast("string").alias(n) for n in others])
    found.update({n: t.value if t else "" for n, t in most_frequent(as_text, others).items()})
    return {n: found[n] for n in names}


def default_features_table(df: DataFrame) -> DataFrame:
    """The default values as a one-row table."""
    values = default_features(df)
    return df.sparkSession.range(1).select(*[F.lit(v).alias(n) for n, v in values.items()])


def column_range(df: DataFrame, name: str) -> DataFrame:
    """Smallest and largest known value, 0.0 when all are missing."""
    value = number(df, name)
    return df.agg(
        F.coalesce(F.min(value), F.lit(0.0)).alias("low"), F.coalesce(F.max(value), F.lit(0.0)).alias("high")
    )


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """Rows per class; missing labels are a class of their own."""
    require_target(df, target)
    return df.groupBy(known(df, target).alias(target)).agg(F.count("*").alias("rows"))


def usable_folds(df: DataFrame, target: str, task: str | None = None) -> DataFrame:
    """Rows, smallest class and number of folds cross-validation can use."""
    task = task or detect_task(df, target)
    if task == CLASSIFICATION:
        sizes = class_counts(df, target).agg(F.sum("rows").alias("rows"), F.min("rows").alias("smallest_class"))
    else:
        sizes = df.agg(F.count("*").alias("rows"), F.lit(None).cast("bigint").alias("smallest_class"))
    return sizes.withColumn("folds", F.least(F.lit(FOLDS).cast("bigint"), "rows", "smallest_class"))

