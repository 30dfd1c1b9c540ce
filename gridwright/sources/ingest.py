"""Recognising files that were already taken in, by name, size and content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridwright.functions.storage import staged

def file_signatures(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file, name, size, digest`` per file.

    The digest depends on every byte: each line, ended by a line feed, is hashed together with its number in
    the file, and the hashes are added up next to the number of lines and the size. So files of any size are
    read in parts by many tasks, in the same way, and the parts do not show in the result.
    """
    sizes = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value",
    )
    # Lines of a block are read in order by one task: their numbers follow from the sizes of the blocks before.
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    starts = staged(starts)  # no more rows than tasks and files
    line = F.col("start") + F.col("id") - F.col("first")
    marks = [F.sum(F.xxhash64("value", line, F.lit(s)).cast("decimal(38,0)")).cast("string") for s in (1, 2, 3, 4)]
    lined = lines.join(starts, ["file", "block"]).groupBy("file").agg(F.concat_ws("|", F.count(F.lit(1)), *marks).alias("marks"))
    name = F.element_at(F.split("file", "/"), -1).alias("name")
    digest = F.sha2(F.concat_ws("|", F.col("size").cast("string"), F.coalesce("marks", F.lit(""))), 256).alias("digest")
    return sizes.join(lined, "file", "left").select("file", name, "size", digest)


def new_files(signatures: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose signature the manifest does not hold yet."""
    return signatures.join(manifest, ["name", "size", "digest"], "left_anti")


def remember_files(signatures: DataFrame, manifest_path: str) -> None:
    """Add signatures to the manifest table."""
    signatures.select("name", "size", "digest").write.mode("append").parquet(manifest_path)
