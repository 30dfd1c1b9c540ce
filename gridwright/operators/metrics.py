"""Scores of predictions, each as a one-row table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.constants import CLASSIFICATION
from gridwright.functions.semantics import column


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy and F1 weighted by class size; an undefined class F1 counts as 0.

    Rows are first reduced to counts per (label, prediction).
    """
    cells = df.groupBy(column(label).alias("y"), column(prediction).alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("y").eqNullSafe(F.col("p")), F.col("n")).otherwise(0)
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("y").alias("c"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("said"), hit.alias("hit")),
                F.struct(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("hit")),
            )
        )
    )
    per_class = sides.groupBy("c").agg(*[F.sum(x).alias(x) for x in ("support", "said", "hit")])
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("support") + F.col("said")), F.lit(0.0))
    rows = F.sum("support")
    return per_class.agg(
        F.try_divide(F.sum("hit").cast("double"), rows).alias("Accuracy"),
        F.try_divide(F.sum(f1 * F.col("support")), rows).alias("F1"),
    )


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """R2 and mean squared error. With a constant label R2 is 1 if all fit, else 0."""
    y, p = column(label).cast("double"), column(prediction).cast("double")
    sums = df.agg(
        F.avg((y - p) * (y - p)).alias("MSE"),
        F.var_pop(y).alias("v"),
        (F.min(y) == F.max(y)).alias("flat"),
    )
    constant = F.when(F.col("MSE") == 0, 1.0).otherwise(0.0)
    r2 = F.when(F.col("flat"), constant).otherwise(1 - F.try_divide(F.col("MSE"), F.col("v")))
    return sums.select(r2.alias("R2"), "MSE")


def score(df: DataFrame, label: str, prediction: str, task: str) -> dict[str, float]:
    measure = classification_metrics if task == CLASSIFICATION else regression_metrics
    return measure(df, label, prediction).first().asDict()
