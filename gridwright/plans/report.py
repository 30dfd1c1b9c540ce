"""The markdown report: Spark computes the few numbers and rows it shows."""

from __future__ import annotations

import time
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame

from gridwright.functions.ranks import top_rows
from gridwright.operators.checks import require_rows
from gridwright.operators.profile import dataset_stats, missing_by_column

MISSING_ROWS = 15
SAMPLE_ROWS = 8


def markdown_table(df: DataFrame) -> str:
    """A small table as markdown; callers limit its rows."""
    def cell(value) -> str:
        return "" if value is None else str(value).replace("|", "\\|").replace("\n", " ")

    lines = ["| " + " | ".join(cell(c) for c in df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(v) for v in row) + " |" for row in df.collect()]
    return "\n".join(lines)


def build_report(
    df: DataFrame, raw: DataFrame | None, steps: Sequence[str], target: str | None,
    baseline: Any = None, metrics: Any = None, order_by: Sequence[str] = (),
) -> str:
    """Summary, missing cells, steps, first rows and model scores."""
    require_rows(df)
    lines = ["# Data Science Project Report", "", f"Generated: {time.strftime('%Y-%m-%d %H:%M:%S')}", ""]
    lines += ["## Dataset summary", f"Target: **{target or '(not selected)'}**", ""]
    for title, table in (("Raw", raw), ("Current", df)):
        if table is not None:
            lines += [f"- {title} {name}: {n}" for name, n in dataset_stats(table).first().asDict().items()]
    lines += ["", "## Top missing columns (top 15)", markdown_table(missing_by_column(df, MISSING_ROWS))]
    lines += ["", "## Cleaning / engineering steps", *([f"- {s}" for s in steps] or ["- (none)"])]
    lines += ["", "## Sample rows (first 8)", markdown_table(top_rows(df, SAMPLE_ROWS, order_by))]
    for title, scores in (("Baseline", baseline), ("Model", metrics)):
        if scores is not None:
            lines += ["", f"## {title}", f"- {scores}"]
    return "\n".join(lines).strip()


def workspace_report(workspace, order_by: Sequence[str] = ()) -> str:
    """The report of a workspace and its last trained model."""
    model = workspace.model
    return build_report(
        workspace.current, workspace.raw, workspace.steps, workspace.target,
        model.baseline if model else None, model.metrics if model else None, order_by,
    )
