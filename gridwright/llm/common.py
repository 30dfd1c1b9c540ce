"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the letters' case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def text_key(text: Column) -> Column:
    """128 bits that stand for a whole text: equal texts have equal keys."""
    return F.unhex(F.md5(text))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64 bits: the finishing steps of a well-known integer hash."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words; of all words together if there are fewer (none: no hash)."""
    n = len(words)
    if n == 0:
        return words
    width = min(width, n)
    h = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[i : n - width + 1 + i] + np.uint64(i))
    return h


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column from one array per row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def values(column: pa.Array, rows: int = 256) -> Iterator:
    """The values of a column one by one; only a few of them are Python objects at a time."""
    for i in range(0, len(column), rows):
        yield from column.slice(i, rows).to_pylist()
    pa.default_memory_pool().release_unused()


def mapped(column: pa.Array, function: Callable, kind: pa.DataType, rows: int = 256) -> pa.Array:
    """``function`` of each value, as a column; made in parts, so that few values at a time are Python objects."""
    parts = [
        pa.array([function(v) for v in column.slice(i, rows).to_pylist()], kind) for i in range(0, len(column), rows)
    ]
    found = pa.concat_arrays(parts) if parts else pa.array([], kind)
    del parts
    pa.default_memory_pool().release_unused()
    return found


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts at a time become Python strings."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        pa.default_memory_pool().release_unused()
