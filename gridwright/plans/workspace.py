"""A table under work: the raw and the current state, undo, log and snapshots."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from gridwright.constants import HISTORY_DEPTH
from gridwright.functions.storage import staged
from gridwright.operators.checks import checked
from gridwright.operators.profile import TableMark, dataset_stats, table_mark
from gridwright.sources.tables import forget_snapshot, load_snapshot, read_table, save_snapshot

# After this many steps on top of each other the current table is written out.
STEPS_PER_STAGE = 10


class Workspace:
    """Holds lazy tables on the driver; the data stays in Spark.

    History entries are DataFrames, not copies. A long chain of steps is written to
    the shared folder now and then so its plan stays short.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder
        self._empty()

    def _empty(self) -> None:
        self.raw: DataFrame | None = None
        self.current: DataFrame | None = None
        self.history: list[DataFrame] = []
        self.steps: list[str] = []
        self.pending: DataFrame | None = None
        self.model: Any = None
        self.target: str | None = None
        self._base: DataFrame | None = None
        self._base_stats: dict[str, int] | None = None
        self._mark: TableMark | None = None  # of the current table, once it is needed
        self._marks: list[TableMark | None] = []  # of the tables in the history
        self._stats: dict[str, int] | None = None
        self._depth = 0
        self._restored = False

    # -- loading ----------------------------------------------------------------

    def load(self, df: DataFrame, label: str, raw: DataFrame | None = None) -> Workspace:
        """Start over with a table."""
        current = checked(df, "Dataset load")
        source = current if raw is None else checked(raw, "Raw dataset load")
        self._empty()
        self.raw, self.current, self._base = source, current, current
        self.steps = [label]
        return self

    def load_path(self, path: str) -> Workspace:
        return self.load(read_table(self.spark, path), f"Loaded dataset: {path.rstrip('/').rsplit('/', 1)[-1]}")

    # -- steps ------------------------------------------------------------------

    def log(self, text: str) -> None:
        """Note a step; blanks and repeats of the last entry are left out."""
        text = str(text).strip()
        if text and (not self.steps or self.steps[-1] != text):
            self.steps.append(text)

    def apply(self, step: Callable[[DataFrame], DataFrame], label: str, detect_no_change: bool = True) -> bool:
        """Run a step; ``False`` when it changed nothing, an error when its result is no usable table."""
        return self._install(step(self._need()), label, detect_no_change)

    def _install(self, result: DataFrame, label: str, detect_no_change: bool = True) -> bool:
        result = checked(result, label)
        self.pending = None
        mark = None
        if detect_no_change:
            # Each version is marked once; the mark of the table before the step is known from its own step.
            self._mark = self._mark or table_mark(self._need())
            mark = table_mark(result)
            if mark.same(self._mark):
                return False
        self.history = (self.history + [self._need()])[-HISTORY_DEPTH:]
        self._marks = (self._marks + [self._mark])[-HISTORY_DEPTH:]
        self._depth += 1
        if self._depth >= STEPS_PER_STAGE:
            result, self._depth = staged(result), 0
        self._set(result, mark)
        self.log(label)
        return True

    def _set(self, df: DataFrame, mark: TableMark | None = None) -> None:
        self.current, self._stats, self.pending, self._mark = df, None, None, mark
        if self.target not in df.columns:
            self.target = None

    def _need(self) -> DataFrame:
        if self.current is None:
            raise ValueError("The workspace is empty.")
        return self.current

    def undo(self, label: str = "Undo") -> bool:
        """Back to the table before the last step; ``False`` when there is none."""
        if not self.history:
            return False
        mark = self._marks.pop() if self._marks else None
        self._set(checked(self.history.pop(), "Undo snapshot"), mark)
        self.log(label)
        return True

    def reset(self) -> bool:
        """Back to the raw table, as a step that can be undone."""
        if self.raw is None:
            raise ValueError("The workspace is empty.")
        return self._install(self.raw, "Reset to original upload")

    def reset_workspace(self) -> None:
        """Forget tables, history, steps, model and the saved snapshot."""
        if self.folder:
            forget_snapshot(self.spark, self.folder)
        self._empty()

    def check(self) -> bool:
        """Repair an unusable current table: undo, else the raw table, else an error."""
        if self.current is None:
            return True
        try:
            checked(self.current, "Current dataset state")
            return True
        except ValueError as problem:
            while self.history:
                try:
                    if self.undo("Auto-recover: reverted invalid state"):
                        return False
                except ValueError:
                    continue
            try:
                self._set(checked(self.raw, "Raw recovery"))
            except ValueError:
                raise ValueError(f"No usable table is left; the workspace could not be recovered: {problem}") from problem
            self.history, self._marks = [], []
            self.log("Auto-recover: restored uploaded dataset")
            return False

    # -- a result that waits for a decision ---------------------------------------

    def stage(self, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Run a user's step and keep its result aside."""
        self.pending = checked(step(self._need()), "Pending transform")
        return self.pending

    def commit(self) -> bool:
        if self.pending is None:
            raise ValueError("Nothing is pending.")
        return self._install(self.pending, "Applied pending transform from script")

    def discard(self) -> None:
        self.pending = None

    # -- numbers ------------------------------------------------------------------

    def stats(self) -> dict[str, int]:
        """Statistics of the current table, computed once per version."""
        if self._stats is None:
            self._stats = dataset_stats(self._need()).first().asDict()
        return self._stats

    def delta(self) -> dict[str, int]:
        """The current statistics less those of the table as it was loaded, which are computed once."""
        if self._base_stats is None:
            self._base_stats = dataset_stats(self._base).first().asDict()
        return {name: value - self._base_stats[name] for name, value in self.stats().items()}

    # -- snapshots ------------------------------------------------------------------

    def save(self, remember: bool = True) -> bool:
        """Write raw and current; with remember mode off, forget what was saved."""
        if not self.folder:
            raise ValueError("The workspace has no folder.")
        if not remember:
            if self._restored:  # its tables are read from what is deleted now
                self.raw, self.current = staged(self.raw), staged(self.current)
                self._base, self.history, self._marks, self._restored = self.current, [], [], False
            forget_snapshot(self.spark, self.folder)
            return False
        if self.current is None:
            return False
        save_snapshot(self.spark, self.folder, self.current, self.raw, {"target": self.target})
        return True

    def restore(self, remember: bool = True) -> bool:
        """Load the saved tables; ``False`` when there are none or remember mode is off."""
        if not self.folder:
            raise ValueError("The workspace has no folder.")
        found = load_snapshot(self.spark, self.folder) if remember else None
        if found is None:
            return False
        current, raw, settings = found
        self.load(current, "Loaded saved progress", raw)
        self._restored = True
        target = settings.get("target")
        self.target = target if target in current.columns else None
        return True
