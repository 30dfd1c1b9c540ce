"""The data behind charts: bins, boxes, bars, points and correlations."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.constants import HISTOGRAM_BINS
from gridwright.functions.quantiles import grouped_quantiles
from gridwright.functions.ranks import seeded_sample
from gridwright.functions.semantics import (
    column,
    is_numeric,
    known,
    missing,
    number,
    numeric_columns,
    require_columns,
    require_numeric,
)
from gridwright.functions.storage import staged

# Up to this many columns all pairs fit comfortably into one generated aggregate.
JVM_COLUMNS = 12
# Tasks' sums that are added in one further task; pairs whose sums travel in one row (48 bytes each).
FAN_IN = 16
STRIP_PAIRS = 200_000


def histogram(df: DataFrame, name: str, bins: int = HISTOGRAM_BINS, by: str | None = None) -> DataFrame:
    """Rows per equal-width bin for numbers, per value for everything else.

    The last bin includes the maximum; a constant column has one bin.
    """
    require_columns(df, [name] + ([by] if by else []))
    extra = [column(by)] if by else []
    if not is_numeric(df.schema[name].dataType):
        shown = F.coalesce(known(df, name).cast("string"), F.lit("nan"))
        return df.groupBy(*extra, shown.alias("value")).agg(F.count("*").alias("rows"))
    value = number(df, name)
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None or low == high:
        bucket = F.when(value.isNotNull(), 1)
        width = 0.0
    else:
        bucket = F.least(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).cast("int")
        width = (high - low) / bins
    counts = (
        df.where(~missing(df, name)).groupBy(*extra, bucket.alias("bin")).agg(F.count("*").alias("rows"))
    )
    start = F.lit(low) + (F.col("bin") - 1) * F.lit(width)
    return counts.select(
        *([by] if by else []), "bin", start.alias("low"), (start + F.lit(width)).alias("high"), "rows"
    )


def box_summary(df: DataFrame, x: str, y: str) -> DataFrame:
    """Per ``x``: rows, quartiles of ``y``, whiskers (furthest values within 1.5 IQR) and outliers."""
    require_columns(df, [x])
    require_numeric(df, [y], "Box")
    # Equal values are counted once; quartiles and whiskers both follow from the counts.
    counts = staged(
        df.select(known(df, x).alias("_x"), number(df, y).alias("_y")).na.drop().groupBy("_x", "_y").agg(F.count("*").alias("_n"))
    )
    quartiles = staged(grouped_quantiles(counts, "_x", "_y", [0.25, 0.5, 0.75], count="_n").select(
        "_x", F.col("n").alias("rows"), F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")
    ))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("_y").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        counts.join(quartiles, "_x")
        .groupBy(F.col("_x").alias(x), "rows", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("_y"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("_y"))).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("outliers"),
        )
    )


def bar_sum(df: DataFrame, x: str, y: str) -> DataFrame:
    """Bars of one ``x`` stack up, so the height is the sum of ``y``."""
    require_columns(df, [x])
    require_numeric(df, [y], "Bar")
    return df.groupBy(known(df, x).alias(x)).agg(F.sum(number(df, y)).alias("height"))


def scatter_points(df: DataFrame, x: str, y: str, key: Sequence[str], limit: int | None = None) -> DataFrame:
    """All points of a scatter chart; a given ``limit`` picks a seeded sample of that size."""
    require_columns(df, [x, y, *key])
    points = df.select(*[column(c) for c in dict.fromkeys([*key, x, y])])
    return points if limit is None else seeded_sample(points, limit, key)


def correlation_matrix(df: DataFrame, names: Sequence[str] | None = None, jvm_columns: int = JVM_COLUMNS) -> DataFrame:
    """All pairs of numeric columns, both ways round and with the diagonal, in long form."""
    names = list(names if names is not None else numeric_columns(df))
    require_numeric(df, names, "Correlation")
    if len(names) < 2:
        raise ValueError("Need at least 2 numeric columns.")
    values = df.select(*[number(df, n).alias(f"v{i}") for i, n in enumerate(names)])
    facts = values.agg(
        F.count("*").alias("rows"),
        *[f(c).alias(f"{tag}{c}") for c in values.columns for tag, f in (("n", F.count), ("a", F.avg))],
    ).first()
    centre = [facts[f"a{c}"] if facts[f"a{c}"] is not None else 0.0 for c in values.columns]
    if len(names) <= jvm_columns:
        complete = [facts[f"n{c}"] == facts["rows"] for c in values.columns]
        sums = _few_columns(values, centre, complete)
    else:
        sums = _many_columns(values, centre)
    half = _correlation(sums, names)
    both = F.array(
        F.struct(F.col("a").alias("col_a"), F.col("b").alias("col_b"), F.col("r")),
        F.struct(F.col("b").alias("col_a"), F.col("a").alias("col_b"), F.col("r")),
    )
    one = F.array(F.struct(F.col("a").alias("col_a"), F.col("b").alias("col_b"), F.col("r")))
    return half.select(F.inline(F.when(F.col("a") == F.col("b"), one).otherwise(both)))


PAIR_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
PAIR_SCHEMA = "i int, j int, " + ", ".join(f"{k} double" for k in PAIR_SUMS)


def _few_columns(values: DataFrame, centre: list[float], complete: list[bool]) -> DataFrame:
    """Pair sums in one generated aggregate.

    Values are shifted by the column mean, which keeps the sums accurate. Columns
    without missing cells share their own sums, so a pair of them adds only one.
    """
    shifted = [F.col(c) - F.lit(m) for c, m in zip(values.columns, centre)]
    aggregates, pairs = [F.count("*").cast("double").alias("rows")], []
    for i, x in enumerate(shifted):
        if complete[i]:
            aggregates += [F.sum(x).alias(f"s{i}"), F.sum(x * x).alias(f"q{i}")]
    for i, j in itertools.combinations_with_replacement(range(len(shifted)), 2):
        x, y = shifted[i], shifted[j]
        aggregates.append(F.sum(x * y).alias(f"p{i}_{j}"))
        if complete[i] and complete[j]:
            parts = ["rows", f"s{i}", f"s{j}", f"q{i}", f"q{j}"]
        else:
            x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
            parts = [f"{k}{i}_{j}" for k in ("n", "x", "y", "xx", "yy")]
            found = [F.count(x + y).cast("double"), F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y)]
            aggregates += [f.alias(p) for f, p in zip(found, parts)]
        pairs.append((i, j, [*parts, f"p{i}_{j}"]))
    row = values.agg(*aggregates).first()
    table = [(i, j, *[row[p] or 0.0 for p in parts]) for i, j, parts in pairs]
    return values.sparkSession.createDataFrame(table, PAIR_SCHEMA)


def _strips(size: int) -> list[tuple[int, int]]:
    """Runs of matrix rows whose part of the upper triangle is of about ``STRIP_PAIRS`` pairs, at least one row."""
    edges, start, held = [], 0, 0
    for row in range(size):
        held += size - row
        if held >= STRIP_PAIRS or row == size - 1:
            edges.append((start, row + 1))
            start, held = row + 1, 0
    return edges


def _many_columns(values: DataFrame, centre: list[float]) -> DataFrame:
    """Pair sums as small matrix products per Arrow batch, packed, and added up by a tree of tasks.

    A task hands on its upper triangle in one row for each strip of it (mostly there is one strip), as bytes. Some such
    rows at a time are added in the next level, in the order of the tasks, until one row is left; only that one is taken
    apart into pairs.
    """
    size, shift = len(centre), np.array(centre)
    strips = _strips(size)
    inside = [np.triu_indices(size)[0].searchsorted([lo, hi]) for lo, hi in strips]
    left, right = np.triu_indices(size)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = batch.to_pandas().to_numpy(dtype="float64", na_value=np.nan) - shift
            have = ~np.isnan(x)
            x = np.where(have, x, 0.0)
            have = have.astype("float64")
            square = x * x
            total = np.zeros((len(PAIR_SUMS), len(left))) if total is None else total
            for k, (m, n) in enumerate(((have, have), (x, have), (have, x), (square, have), (have, square), (x, x))):
                total[k] += (m.T @ n)[left, right]
        if total is not None:
            slot = TaskContext.get().partitionId()
            for strip, (lo, hi) in enumerate(inside):
                yield _packed(strip, slot, np.ascontiguousarray(total[:, lo:hi]))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, total = None, None
        for batch in batches:
            for strip, slot, packed in zip(*(batch.column(c) for c in ("strip", "slot", "packed"))):
                at, own = (strip.as_py(), slot.as_py() // FAN_IN), np.frombuffer(packed.as_buffer(), np.float64)
                if at != here:
                    if here is not None:
                        yield _packed(*here, total)
                    here, total = at, own.copy()
                else:
                    total += own
        if here is not None:
            yield _packed(*here, total)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for strip, packed in zip(batch.column("strip").to_pylist(), batch.column("packed")):
                lo, hi = inside[strip]
                own = np.frombuffer(packed.as_buffer(), np.float64).reshape(len(PAIR_SUMS), -1)
                for at in range(0, hi - lo, 100_000):
                    part = slice(at, at + 100_000)
                    found = [pa.array(x[lo:hi][part].astype(np.int32)) for x in (left, right)] + [pa.array(k[part]) for k in own]
                    yield pa.RecordBatch.from_arrays(found, ["i", "j", *PAIR_SUMS])

    rows = staged(values.mapInArrow(sums, PACKED_SCHEMA))
    tasks = (rows.agg(F.max("slot")).first()[0] or 0) + 1
    while tasks > 1:
        order = ["strip", F.floor(F.col("slot") / FAN_IN), "slot"]
        rows = rows.repartition(*order[:2]).sortWithinPartitions(*order).mapInArrow(added, PACKED_SCHEMA)
        tasks = -(-tasks // FAN_IN)
    return rows.mapInArrow(pairs, PAIR_SCHEMA)


PACKED_SCHEMA = "strip int, slot int, packed binary"


def _packed(strip: int, slot: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([strip], pa.int32()), pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["strip", "slot", "packed"]
    )


def _correlation(sums: DataFrame, names: list[str]) -> DataFrame:
    """Pearson per pair over the rows where both are known; null where either is constant there."""
    n = F.col("n")
    vx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), n)
    vy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n)
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n)
    # What rounding alone leaves of a constant column is not a spread.
    varies = (vx > 1e-12 * F.col("sxx")) & (vy > 1e-12 * F.col("syy"))
    r = F.when(varies, F.least(F.greatest(cov / (F.sqrt(vx) * F.sqrt(vy)), F.lit(-1.0)), F.lit(1.0)))
    label = F.array(*[F.lit(c) for c in names])
    return sums.select(
        F.element_at(label, F.col("i") + 1).alias("a"), F.element_at(label, F.col("j") + 1).alias("b"), r.alias("r")
    )


def top_pair(matrix: DataFrame) -> DataFrame:
    """The pair with the largest absolute correlation, the diagonal left out."""
    return (
        matrix.where((F.col("col_a") < F.col("col_b")) & F.col("r").isNotNull())
        .orderBy(F.desc(F.abs("r")), "col_a", "col_b").limit(1)
    )


def strongest_columns(matrix: DataFrame, top: int = 10) -> DataFrame:
    """Columns by their mean absolute correlation, the one with itself included."""
    return (
        matrix.groupBy("col_a").agg(F.avg(F.abs("r")).alias("mean_abs_r"))
        .orderBy(F.desc_nulls_last("mean_abs_r"), "col_a").limit(top)
    )


def heat_map(matrix: DataFrame, top: int = 10) -> DataFrame:
    """The part of the matrix between the strongest columns."""
    best = strongest_columns(matrix, top).select("col_a")
    return matrix.join(best, "col_a", "left_semi").join(
        best.withColumnRenamed("col_a", "col_b"), "col_b", "left_semi"
    ).select("col_a", "col_b", "r")


def suggest_charts(
    df: DataFrame, key: Sequence[str], target: str | None = None, limit: int = 3
) -> dict[str, DataFrame]:
    """Up to three named chart tables: the target, the top pair, the heat map."""
    charts: dict[str, DataFrame] = {}
    if target and target in df.columns:
        charts["Target distribution"] = histogram(df, target)
    if len(numeric_columns(df)) >= 2:
        matrix = correlation_matrix(df)
        best = top_pair(matrix).first()
        if best:
            a, b = best["col_a"], best["col_b"]
            charts[f"Top correlated pair: {a} vs {b}"] = scatter_points(df, a, b, key)
        charts["Correlation heatmap (top 10 numeric)"] = heat_map(matrix)
    return dict(list(charts.items())[:limit])
