"""Cleaning values learned from a batch, applied to any table or stream."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gridwright.operators.missing import AUTO, Fill, apply_fill, fit_fill
from gridwright.operators.outliers import DEFAULT_FACTOR, Bounds, apply_clip, fit_bounds, presence_flag


@dataclass(frozen=True)
class FittedCleaning:
    """Fill values, clip bounds and flags; applying them is one stateless projection each."""

    fill: Fill
    bounds: dict[str, Bounds] = field(default_factory=dict)
    flags: tuple[str, ...] = ()

    @staticmethod
    def fit(
        df: DataFrame, fill: Sequence[str] = (), strategy: str = AUTO, clip: Sequence[str] = (),
        factor: float = DEFAULT_FACTOR, flags: Sequence[str] = (),
    ) -> FittedCleaning:
        """Learn from a batch. Bounds are those of the filled columns."""
        values = fit_fill(df, list(fill), strategy)
        return FittedCleaning(values, fit_bounds(apply_fill(df, values), list(clip), factor), tuple(flags))

    def apply(self, df: DataFrame) -> DataFrame:
        """Flags first, as they tell which cells were missing; then fills, then clips."""
        for source in self.flags:
            df = presence_flag(df, source)
        return apply_clip(apply_fill(df, self.fill), self.bounds)

    def start(self, stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
        """Clean what is available in the stream and append it to a Parquet table."""
        writer = self.apply(stream).writeStream.format("parquet").outputMode("append")
        return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
