"""The folder that all machines share, and tables kept there between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset on a local master, as in tests, a temporary one becomes it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Shuffle files of the statement go when it ends, so that steps don't pile them up until the driver collects its garbage.
_WHILE_SAVING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def save(df: DataFrame, settings: dict[str, str] | None = None, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it, so that later work doesn't depend on its lineage or shuffle files.

    ``settings`` are Spark's while it is written, ``options`` the writer's.
    """
    spark = df.sparkSession
    path = new_path(spark)
    held = _WHILE_SAVING | (settings or {})
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        df.write.options(**options).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)
