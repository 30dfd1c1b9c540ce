"""Exact quantiles with linear interpolation that do not outgrow one task.

Where a column has few distinct values (this is measured), rows are first counted per
value, a shuffle with map-side combining, and the quantile is taken over the counts.
Otherwise each wanted rank is bracketed with a sketch, the bracket is checked by exact
counts, and the step repeats inside it until few rows remain. Those passes are scans
with tiny shuffles; nothing is sorted globally. The sketch may be built on a sample of
the rows, as it only proposes a bracket: the counts, over all rows, decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridwright.constants import BUFFER_VALUES, SEED
from gridwright.functions.frequencies import stacked_counts
from gridwright.functions.semantics import column, known, number
from gridwright.functions.storage import staged

SKETCH_ACCURACY = 10_000
SKETCH_SLACK = 2.0 / SKETCH_ACCURACY
# Rows a sketch sees; with very many tasks, sketches of all rows would swamp the last one.
SKETCH_ROWS = 4_000_000
# Limits on what one aggregation buffer holds over all columns of a pass.
PASS_VALUES = 1_000_000
PASS_RANKS = 96


def size_aggregates(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Known values and their approximate distinct count, per column.

    Callers that aggregate anyway add these, and pass the row to ``exact_quantiles``.
    """
    values = [number(df, n) for n in names]
    return [F.count(v).alias(f"_n{i}") for i, v in enumerate(values)] + [
        F.approx_count_distinct(v).alias(f"_d{i}") for i, v in enumerate(values)
    ]


def exact_quantiles(
    df: DataFrame, names: Sequence[str], probs: Sequence[float], buffer_values: int = BUFFER_VALUES,
    sizes: Row | None = None, sketch_rows: int = SKETCH_ROWS,
) -> dict[str, list[float | None]]:
    """Quantiles per column, missing cells left out; ``None`` where all are missing."""
    if not names:
        return {}
    values = [number(df, n) for n in names]
    if sizes is None:
        sizes = df.agg(*size_aggregates(df, names)).first()
    found: dict[str, list[float | None]] = {}
    buffered, rest = [], []
    for i, name in enumerate(names):
        if sizes[f"_n{i}"] == 0:
            found[name] = [None] * len(probs)
        else:
            (buffered if sizes[f"_d{i}"] <= buffer_values else rest).append(i)
    for some in _batches(buffered, [sizes[f"_d{i}"] for i in buffered], PASS_VALUES):
        slim = df.select(*[values[i].alias(f"v{i}") for i in some])
        counts = stacked_counts(slim, slim.columns)
        answers = counts.groupBy("slot").agg(
            F.percentile("value", F.array(*map(F.lit, probs)), F.col("n")).alias("q")
        )
        found.update({names[some[r["slot"]]]: list(r["q"]) for r in answers.collect()})  # one row per column
    # A rank needs a sketch and a gathered list, so a pass takes a limited number of them.
    for some in _batches(rest, [2 * len(probs)] * len(rest), PASS_RANKS):
        wanted = {}
        for i in some:
            for p in probs:
                place = p * (sizes[f"_n{i}"] - 1)
                for rank in (math.floor(place), math.ceil(place)):
                    wanted[(i, rank)] = _Bracket(rank=rank, inside=sizes[f"_n{i}"])
        _narrow(df, values, wanted, min(buffer_values, PASS_VALUES // len(wanted)), sketch_rows)
        for i in some:
            answers = []
            for p in probs:
                place = p * (sizes[f"_n{i}"] - 1)
                low = wanted[(i, math.floor(place))].answer
                high = wanted[(i, math.ceil(place))].answer
                # The built-in percentile's formula, so that both paths agree to the last bit.
                share = (math.ceil(place) - place) * low + (place - math.floor(place)) * high
                answers.append(low if low == high else share)
            found[names[i]] = answers
    return {n: found[n] for n in names}


def _batches(items: list[int], weights: list[int], limit: int) -> Iterator[list[int]]:
    """Cut a list into runs whose weights add up to the limit, or hold one item."""
    run: list[int] = []
    load = 0
    for item, weight in zip(items, weights):
        if run and load + weight > limit:
            yield run
            run, load = [], 0
        run.append(item)
        load += weight
    if run:
        yield run


@dataclass
class _Bracket:
    """An open interval known to hold the value at a 0-based rank."""

    rank: int
    inside: int  # rows strictly between low and high
    below: int = 0  # rows at or under low
    low: float | None = None
    high: float | None = None
    answer: float | None = None

    def holds(self, value: Column) -> Column:
        inside = value.isNotNull()
        if self.low is not None:
            inside = inside & (value > self.low)
        if self.high is not None:
            inside = inside & (value < self.high)
        return inside


def _narrow(
    df: DataFrame, values: list[Column], wanted: dict[tuple, _Bracket], gather: int, sketch_rows: int = SKETCH_ROWS
) -> None:
    """Find the value at every wanted rank; ranks in the same interval share its sketch or list."""
    draws = SEED
    while True:
        shared: dict[tuple, list[_Bracket]] = {}
        for (i, _), b in wanted.items():
            if b.answer is None:
                shared.setdefault((i, b.low, b.high), []).append(b)
        if not shared:
            return
        aggregates, picks = [], []
        for g, ((i, _, _), ranks) in enumerate(shared.items()):
            holds, rows = ranks[0].holds(values[i]), ranks[0].inside
            if rows <= gather:
                aggregates.append(F.array_sort(F.collect_list(F.when(holds, values[i]))).alias(f"x{g}"))
                at = [F.lit(b.rank - b.below + 1) for b in ranks]
                picks.append(F.array(*[F.element_at(F.col(f"x{g}"), n) for n in at]).alias(f"x{g}"))
            else:
                part = min(1.0, sketch_rows / rows)
                # Four deviations of a sampled share, on top of the sketch's own error.
                slack = SKETCH_SLACK + (2.0 / math.sqrt(sketch_rows) if part < 1 else 0.0)
                edges = []
                for b in ranks:
                    share = (b.rank - b.below) / b.inside
                    edges += [max(0.0, share - slack), min(1.0, share + slack)]
                used = holds & (F.col("__draw") < part) if part < 1 else holds
                sketch = F.percentile_approx(
                    F.when(used, values[i]), F.array(*map(F.lit, edges)), F.lit(SKETCH_ACCURACY)
                )
                # An unlucky sample may be empty; the interval then stays as it is.
                aggregates.append(sketch.alias(f"x{g}"))
                picks.append(F.col(f"x{g}"))
        draws += 1
        drawn = df.select("*", F.rand(draws).alias("__draw"))
        row = drawn.agg(*aggregates).select(*picks).first()
        refine = []
        for g, ((i, _, _), ranks) in enumerate(shared.items()):
            for j, b in enumerate(ranks):
                if b.inside <= gather:
                    b.answer = row[f"x{g}"][j]
                    if b.answer is None:
                        raise RuntimeError("The table changed between two passes; write it out first.")
                elif row[f"x{g}"] is not None:
                    refine.append((i, b, row[f"x{g}"][2 * j], row[f"x{g}"][2 * j + 1]))
        if not refine:
            continue
        counts = []
        for j, (i, b, low, high) in enumerate(refine):
            inside, v = b.holds(values[i]), values[i]
            counts += [
                F.count_if(inside & (v < low)).alias(f"a{j}"),
                F.count_if(inside & (v <= low)).alias(f"b{j}"),
                F.count_if(inside & (v < high)).alias(f"c{j}"),
                F.count_if(inside & (v <= high)).alias(f"d{j}"),
            ]
        row = df.agg(*counts).first()
        for j, (_, b, low, high) in enumerate(refine):
            end = b.below + b.inside
            under_low, to_low, under_high, to_high = (b.below + row[f"{x}{j}"] for x in "abcd")
            if b.rank < under_low:
                b.high, b.inside = low, under_low - b.below
            elif b.rank < to_low:
                b.answer = low
            elif b.rank < under_high:
                b.low, b.high, b.below, b.inside = low, high, to_low, under_high - to_low
            elif b.rank < to_high:
                b.answer = high
            else:
                b.low, b.below, b.inside = high, to_high, end - to_high


def grouped_quantiles(
    df: DataFrame, by: str, value: str, probs: Sequence[float], buffer_values: int = BUFFER_VALUES,
    count: str | None = None,
) -> DataFrame:
    """Exact quantiles of ``value`` per ``by`` as columns ``q0, q1, ...``; a column ``count`` repeats rows."""
    kind = df.schema[by].dataType
    times = F.lit(1) if count is None else column(count)
    rows = df.select(known(df, by).alias("_by"), number(df, value).alias("_v"), times.alias("_c")).na.drop()
    widest = (
        rows.groupBy("_by").agg(F.approx_count_distinct("_v").alias("d")).agg(F.max("d")).first()[0] or 0
    )
    if widest <= buffer_values:
        counts = rows.groupBy("_by", "_v").agg(F.sum("_c").alias("_n"))
        packed = counts.groupBy("_by").agg(
            F.sum("_n").alias("n"), F.percentile("_v", F.array(*map(F.lit, probs)), F.col("_n")).alias("q")
        )
        return packed.select(
            F.col("_by").cast(kind).alias(by), "n", *[F.col("q")[j].alias(f"q{j}") for j in range(len(probs))]
        )
    ranked = _running_counts(rows)
    totals = staged(ranked.groupBy("_by").agg(F.max("_upto").alias("n")))  # written: the join can split a hot group
    placed = ranked.join(totals, "_by")
    picks = []
    for j, p in enumerate(probs):
        place = F.lit(p) * (F.col("n") - 1)
        for tag, rank in (("l", F.floor(place)), ("h", F.ceil(place))):
            hit = (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"{tag}{j}"))
    packed = placed.groupBy("_by").agg(F.max("n").alias("n"), *picks)
    answers = []
    for j, p in enumerate(probs):
        place = F.lit(p) * (F.col("n") - 1)
        low, high = F.col(f"l{j}"), F.col(f"h{j}")
        share = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
        answers.append(F.when(low == high, low).otherwise(share).alias(f"q{j}"))
    return packed.select(F.col("_by").cast(kind).alias(by), "n", *answers)


def _running_counts(rows: DataFrame) -> DataFrame:
    """Running row count in value order per group, without one task per group.

    Copies are counted first. The counts are range-partitioned on (group, value),
    so a large group spans many partitions; each partition's total gives the next
    one its start.
    """
    counts = rows.groupBy("_by", "_v").agg(F.sum("_c").alias("_n"))
    spread = counts.repartitionByRange("_by", "_v").withColumn("_part", F.spark_partition_id())
    spread = staged(spread)
    totals = spread.groupBy("_by", "_part").agg(F.sum("_n").alias("_t"))
    earlier = Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_by", "_part", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_by", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return spread.join(starts, ["_by", "_part"]).select(
        "_by", "_v", "_n", (F.col("_start") + F.sum("_n").over(within)).alias("_upto")
    )

