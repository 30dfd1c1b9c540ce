"""Row numbers and rank look-ups that never sort a whole table in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridwright.constants import GROUP_ROWS, SEED
from gridwright.functions.semantics import column, quoted
from gridwright.functions.storage import staged


def with_row_index(
    df: DataFrame, order_by: Sequence[str] = (), name: str = "_row", stable: bool = False
) -> DataFrame:
    """Put a dense 0-based row number in front.

    With ``order_by`` the number follows that order (the columns should identify a
    row). Rows are numbered inside each partition and shifted by the sizes of the
    partitions before it. The partitioning is written out first, because it must be
    the same when sizes and rows are read; ``stable=True`` skips this for a plain
    file scan, whose splits do not change.
    """
    if name in df.columns:
        raise ValueError(f"Column already exists: {name}")
    if order_by:
        keys = [column(c) for c in order_by]
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    own = list(df.columns)
    # monotonically_increasing_id is (partition << 33) + position in the partition.
    marked = df.select(
        "*",
        F.spark_partition_id().alias("__part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"),
    )
    if order_by or not stable:
        marked = staged(marked)
    sizes = marked.groupBy("__part").agg(F.count("*").alias("__size"))
    # One row per partition: a small table by construction, also for the broadcast.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    return marked.join(F.broadcast(starts), "__part").select(
        (F.col("__start") + F.col("__at")).alias(name), *[column(c) for c in own]
    )


def total_before(df: DataFrame, order_by: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows that come before in the order; the columns should identify a row.

    Sums run inside range partitions and are shifted by the sums of the partitions before.
    """
    keys = [column(c) for c in order_by]
    marked = staged(df.repartitionByRange(*keys).select("*", F.spark_partition_id().alias("__part")))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy("__part").agg(F.sum(column(value)).alias("__sum")).select(
        "__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start")
    )  # one row per partition
    inside = Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(column(value)).over(inside), F.lit(0))
    return marked.withColumn("__in", within).join(F.broadcast(starts), "__part").select(
        *[column(c) for c in df.columns], (F.col("__start") + F.col("__in")).alias(name)
    )


def hash_order(key: Sequence[str], seed: int = SEED) -> Column:
    """A reproducible pseudo-random order: md5 of the key columns and the seed."""
    return F.md5(F.concat_ws("-", *[column(c).cast("string") for c in key], F.lit(str(seed))))


def hash_bucket(order: Column, rows: int, group_rows: int = GROUP_ROWS) -> Column | None:
    """A prefix of the hash long enough that one bucket holds about ``group_rows``.

    The hash is uniform, so a bucket stays small even when one class holds most
    rows. ``None`` when the table is small enough for a single bucket.
    """
    digits = math.ceil(math.log(rows / group_rows, 16)) if rows > group_rows else 0
    return F.substring(order, 1, digits) if digits else None


def rows_at_ranks(
    rows: DataFrame, group: Sequence[str], order: Sequence[str], targets: DataFrame, bucketed: bool, few: bool
) -> DataFrame:
    """Find which row stands at a given 1-based rank inside its group.

    ``targets`` holds the group columns, ``_target`` and ``_rank``. With ``bucketed``
    the rows carry a ``_bucket`` column that respects the order: bucket sizes locate
    the bucket each rank falls into, and only rows of those buckets are numbered.
    ``few`` says that the caller counted the targets and they may be broadcast.
    """
    group = list(group)
    cut = group + ["_bucket"] if bucketed else group
    if bucketed:
        upto = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
        sizes = rows.groupBy(*cut).agg(F.count("*").alias("_size"))
        ends = sizes.withColumn("_end", F.sum("_size").over(upto))
        hits = (
            ends.join(targets, group)
            .where((F.col("_rank") > F.col("_end") - F.col("_size")) & (F.col("_rank") <= F.col("_end")))
            .select(*cut, "_target", (F.col("_rank") - F.col("_end") + F.col("_size")).alias("_nth"))
        )
        wanted = hits.select(*cut).distinct()
        rows = rows.join(F.broadcast(wanted) if few else wanted, cut, "left_semi")
    else:
        hits = targets.select(*cut, "_target", F.col("_rank").alias("_nth"))
    numbered = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*cut).orderBy(*order)))
    return numbered.join(hits, cut + ["_nth"]).select(*group, "_target", *order)


def seeded_sample(df: DataFrame, size: int, key: Sequence[str], seed: int = SEED) -> DataFrame:
    """Exactly ``min(size, rows)`` rows, the same ones on every run."""
    ordering = [hash_order(key, seed), *[column(c) for c in key]]
    return df.orderBy(*ordering).limit(size)


def top_rows(df: DataFrame, count: int, order_by: Sequence[str] = ()) -> DataFrame:
    """The first rows; say the order when it matters."""
    if order_by:
        df = df.orderBy(*[quoted(c) for c in order_by])
    return df.limit(count)
