"""Parquet tables and workspace snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from gridwright.sources.text_tables import read_csv


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV by its extension in any case, everything else as Parquet."""
    return read_csv(spark, path) if path.lower().endswith(".csv") else read_parquet(spark, path)


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """Write one small text as a one-file folder."""
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """Read what :func:`write_text` wrote; ``None`` when there is nothing."""
    try:
        rows = spark.read.option("wholetext", True).text(path).collect()
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem.getCondition()):
            return None
        raise
    return "".join(r["value"] for r in rows).rstrip("\n") if rows else None


def save_snapshot(spark: SparkSession, folder: str, current: DataFrame, raw: DataFrame | None, settings: dict) -> str:
    """Write both tables and the settings under a new version and point to it last.

    A new version never overwrites files the same plan may read, and a job that dies
    half-way leaves the previous snapshot valid.
    """
    version = uuid.uuid4().hex
    base = f"{folder}/{version}"
    found = read_text(spark, f"{folder}/latest")
    before = json.loads(found) if found else {}
    earlier = [*before.get("earlier", []), before["version"]] if before.get("version") else []
    current.write.parquet(f"{base}/current")
    if raw is not None:
        raw.write.parquet(f"{base}/raw")
    facts = {"version": version, "has_raw": raw is not None, "settings": settings, "earlier": earlier}
    write_text(spark, f"{folder}/latest", json.dumps(facts))
    return base


def load_snapshot(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict] | None:
    """``(current, raw, settings)``; raw is current when none was saved. ``None`` without a snapshot."""
    found = read_text(spark, f"{folder}/latest")
    facts = json.loads(found) if found else {}
    if not facts.get("version"):
        return None
    base = f"{folder}/{facts['version']}"
    current = spark.read.parquet(f"{base}/current")
    raw = spark.read.parquet(f"{base}/raw") if facts["has_raw"] else current
    return current, raw, facts["settings"]


def forget_snapshot(spark: SparkSession, folder: str) -> None:
    """Delete the folder's snapshot: the version that it points to, and then the pointer's content."""
    found = read_text(spark, f"{folder}/latest")
    facts = json.loads(found) if found else {}
    if facts.get("version"):
        write_text(spark, f"{folder}/latest", "{}")
        for version in [*facts.get("earlier", []), facts["version"]]:
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{version}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
