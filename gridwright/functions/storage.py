"""Tables written to the cluster's shared folder, to cut lineage safely."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session (one machine, as in tests) may go without it: there a
    temporary folder is made once and set as the session's checkpoint folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridwright-"))
    return spark.sparkContext.getCheckpointDir()


def staged(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result no longer depends on how ``df`` was computed, survives lost
    executors, and later reads still prune columns.
    """
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Deletes a plan's shuffle files when its query ends; else they wait until the driver happens to collect its objects.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged_alone(df: DataFrame) -> DataFrame:
    """``staged`` for plans that many large ones follow: its shuffle files are deleted, and the table takes less room."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, None)
    conf.set(CLEAN_UP, "true")
    try:
        return staged(df, compression="zstd")
    finally:
        if before is None:
            conf.unset(CLEAN_UP)
        else:
            conf.set(CLEAN_UP, before)
