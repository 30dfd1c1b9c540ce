"""Train/test split and folds, exact in size and the same on every run.

Both are cut points per class: the row standing at a given rank is looked up, and
every row compares itself with its class's cut points. Only the look-up sorts, and
only within small buckets, so the table itself is never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridwright.constants import BROADCAST_ROWS, CLASSIFICATION, FOLDS, GROUP_ROWS, HISTOGRAM_BINS, REGRESSION, SEED
from gridwright.functions.ranks import hash_bucket, hash_order, rows_at_ranks, total_before, with_row_index
from gridwright.functions.semantics import column, known, require_columns
from gridwright.operators.charts import histogram
from gridwright.operators.checks import require_target
from gridwright.operators.columns import features_and_label
from gridwright.operators.profile import class_counts, detect_task, usable_folds

TRAIN, TEST = "Train", "Test"


@dataclass(frozen=True)
class SplitPlan:
    """Sizes of a split, found from one count per class."""

    rows: int
    train_rows: int
    test_rows: int
    classes: int
    stratified: bool


def _class_sizes(df: DataFrame, label: str | None) -> DataFrame:
    """Rows per class; without a label all rows are one class."""
    group = known(df, label) if label else F.lit(0)
    return df.groupBy(group.alias("_class")).agg(F.count("*").alias("_size"))


def plan_split(df: DataFrame, label: str, fraction: float, task: str, strict: bool = True) -> SplitPlan:
    """Check that the split is possible and find its sizes.

    A class with a single row is an error when strict; otherwise (a preview) the
    split is made without regard to classes.
    """
    require_target(df, label)
    if task not in (CLASSIFICATION, REGRESSION):
        raise ValueError(f"Unknown task type: {task}")
    fraction = float(fraction)
    if not 0.0 < fraction < 1.0:
        raise ValueError("The test share lies above 0 and below 1.")
    rows, smallest, classes, unlabelled = (
        _class_sizes(df, label if task == CLASSIFICATION else None)
        .agg(
            F.coalesce(F.sum("_size"), F.lit(0)), F.coalesce(F.min("_size"), F.lit(0)), F.count("*"),
            F.count_if(F.col("_class").isNull()),
        )
        .first()
    )
    if unlabelled:
        raise ValueError("The label has missing values; fill them or drop their rows.")
    if rows < (4 if strict else 2):
        raise ValueError("Fewer than 4 rows are too few for training and testing.")
    stratified = task == CLASSIFICATION
    if stratified and smallest < 2:
        if strict:
            raise ValueError("A split by class takes 2 rows or more in each target class.")
        stratified = False
    test = math.ceil(fraction * rows)
    train = rows - test
    if train == 0:
        raise ValueError("test_size leaves no training rows.")
    if stratified and min(test, train) < classes:
        raise ValueError(f"test_size leaves a part with fewer rows than the {classes} classes.")
    return SplitPlan(rows, train, test, classes if stratified else 1, stratified)


def _test_quotas(sizes: DataFrame, plan: SplitPlan, group_rows: int) -> DataFrame:
    """Test rows per class: training rows are shared by largest remainder, in whole numbers.

    The table has one row per class. Ties go to the smaller class value. Up to ``group_rows`` classes are ranked in
    one task, more by range partitions.
    """
    product = F.col("_size").cast("decimal(38,0)") * F.lit(plan.train_rows).cast("decimal(19,0)")
    whole = F.lit(plan.rows).cast("decimal(19,0)")
    share = sizes.withColumn("_left", product % whole)
    share = share.withColumn("_floor", ((product - F.col("_left")) / whole).cast("bigint"))
    spare = plan.train_rows - share.agg(F.sum("_floor")).first()[0]
    if plan.classes > group_rows:
        share = with_row_index(share.withColumn("_less", -F.col("_left")), ["_less", "_class"], "_place")
        place = F.col("_place")
    else:
        place = F.row_number().over(Window.orderBy(F.desc("_left"), "_class")) - 1
    extra = F.when(place < spare, 1).otherwise(0)
    return share.select("_class", (F.col("_size") - F.col("_floor") - extra).alias("_rank")).where("_rank > 0")


def train_test_split(
    df: DataFrame, label: str, fraction: float, task: str, key: Sequence[str],
    seed: int = SEED, strict: bool = True, name: str = "split", group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Add a ``Train``/``Test`` column.

    ``key`` must identify a row. Within a class the rows with the smallest seeded
    hashes of the key form the test part.
    """
    require_columns(df, key)
    plan = plan_split(df, label, fraction, task, strict)
    return split_by_plan(df, label, plan, key, seed, name, group_rows)


def split_by_plan(
    df: DataFrame, label: str, plan: SplitPlan, key: Sequence[str],
    seed: int = SEED, name: str = "split", group_rows: int = GROUP_ROWS,
) -> DataFrame:
    order = hash_order(key, seed)
    group = known(df, label) if plan.stratified else F.lit(0)
    bucket = hash_bucket(order, plan.rows, group_rows)
    rows = df.select(
        group.alias("_class"), order.alias("_hash"), *[column(c).alias(f"_k{i}") for i, c in enumerate(key)],
        *([bucket.alias("_bucket")] if bucket is not None else []),
    )
    parts = ["_hash", *[f"_k{i}" for i in range(len(key))]]
    sizes = _class_sizes(df, label if plan.stratified else None)
    targets = _test_quotas(sizes, plan, group_rows).withColumn("_target", F.lit(0))
    few = plan.classes <= BROADCAST_ROWS
    cuts = rows_at_ranks(rows, ["_class"], parts, targets, bucket is not None, few)
    cuts = cuts.select("_class", F.struct(*parts).alias("_cut"))
    own = F.struct(order.alias("_hash"), *[column(c).alias(f"_k{i}") for i, c in enumerate(key)])
    marked = df.select("*", group.alias("_class")).join(F.broadcast(cuts) if few else cuts, "_class", "left")
    side = F.when(F.col("_cut").isNotNull() & (own <= F.col("_cut")), TEST).otherwise(TRAIN)
    return marked.select(*[column(c) for c in df.columns], side.alias(name))


def split_preview(df: DataFrame, label: str, fraction: float, task: str, key: Sequence[str]):
    """``(table, stratified, reason)``: the split, or ``None`` and why it cannot be made."""
    try:
        features_and_label(df, label)
        plan = plan_split(df, label, fraction, task, strict=False)
    except ValueError as problem:
        return None, False, str(problem)
    return split_by_plan(df, label, plan, key), plan.stratified, None


def split_sizes(parts: DataFrame, name: str = "split") -> DataFrame:
    """Training rows, test rows and the held-out share in percent."""
    test, rows = F.count_if(column(name) == TEST), F.count("*")
    return parts.agg(
        F.count_if(column(name) == TRAIN).alias("train_rows"),
        test.alias("test_rows"),
        F.round(100.0 * test / F.greatest(rows, F.lit(1)), 1).alias("held_out_pct"),
    )


def split_class_counts(parts: DataFrame, label: str, name: str = "split") -> DataFrame:
    """Rows per class and part, zeros included."""
    shown = column(label).cast("string").alias("class")
    counts = parts.groupBy(shown).agg(
        F.count_if(column(name) == TRAIN).alias(TRAIN), F.count_if(column(name) == TEST).alias(TEST)
    )
    return counts.unpivot(["class"], [TRAIN, TEST], "split", "rows").orderBy("class", F.desc("split"))


def split_target_histogram(parts: DataFrame, label: str, name: str = "split", bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Target bins per part, over all rows."""
    return histogram(parts, label, bins, by=name)


def cv_preview(df: DataFrame, target: str, task: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What cross-validation will see: class counts or target bins, and the usable folds."""
    features_and_label(df, target)
    task = task or detect_task(df, target)
    chart = class_counts(df, target) if task == CLASSIFICATION else histogram(df, target)
    return chart, usable_folds(df, target, task)


def assign_folds(
    df: DataFrame, row: str, folds: int = FOLDS, label: str | None = None, name: str = "fold",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Add a 0-based fold number; rows keep their order, nothing is shuffled at random.

    ``row`` is a dense 0-based row number. Without a label, folds are equal runs of
    rows, the first ones a row longer, which is plain arithmetic. With a label each
    class is cut into runs of its own; how many rows of a class a fold gets follows
    from dealing all rows, ordered by class, round the folds.
    """
    require_columns(df, [row] + ([label] if label else []))
    at = column(row)
    if label is None:
        rows = df.count()
        size, longer = divmod(rows, folds)
        edge = longer * (size + 1)
        late = longer + F.floor((at - edge) / max(size, 1))
        return df.select("*", F.when(at < edge, F.floor(at / (size + 1))).otherwise(late).cast("int").alias(name))
    sizes = df.groupBy(known(df, label).alias("_class")).agg(F.count("*").alias("_size"), F.min(at).alias("_first"))
    rows, classes = sizes.agg(F.sum("_size"), F.count("*")).first()
    # One row per class from here on.
    if classes > group_rows:
        placed = total_before(sizes, ["_first"], "_size", "_start")
    else:
        before = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
        placed = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))

    def dealt(upto, fold):  # positions below `upto` that go to `fold`
        return F.floor((upto + (folds - 1 - fold)) / folds)

    cuts, total = [], F.lit(0)
    for fold in range(folds - 1):
        total = total + dealt(F.col("_start") + F.col("_size"), fold) - dealt(F.col("_start"), fold)
        cuts.append(F.struct(F.lit(fold).alias("_target"), total.cast("bigint").alias("_rank")))
    targets = placed.select("_class", F.inline(F.array(*cuts)))
    few = classes * folds <= BROADCAST_ROWS
    bucketed = rows > group_rows
    slim = df.select(known(df, label).alias("_class"), at.alias("_at"))
    if bucketed:
        slim = slim.withColumn("_bucket", F.floor(F.col("_at") / group_rows))
    found = rows_at_ranks(slim, ["_class"], ["_at"], targets.where("_rank > 0"), bucketed, few)
    # A class with no row in the first folds starts beyond them.
    empty = targets.where("_rank = 0").select("_class", "_target", F.lit(-1).cast("bigint").alias("_at"))
    ends = found.unionByName(empty).groupBy("_class").agg(F.array_sort(F.collect_list("_at")).alias("_ends"))
    marked = df.select("*", known(df, label).alias("_class")).join(F.broadcast(ends) if few else ends, "_class", "left")
    passed = F.lit(0)
    for fold in range(folds - 1):
        passed = passed + (at > F.get(F.col("_ends"), F.lit(fold))).cast("int")
    return marked.select(*[column(c) for c in df.columns], F.coalesce(passed, F.lit(0)).alias(name))

