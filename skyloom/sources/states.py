"""Versions of a state table: each run adds points to the last committed one; states of older formats are migrated."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators.series import STATE, migrate_state, resumed, state_of
from skyloom.sources import files_api as files

FORMAT = "1.1"


def _from_1_0(df: DataFrame) -> DataFrame:
    """Format 1.0 named the series ``name``, the places ``start`` and ``stop``, and kept means instead of sums."""
    df = migrate_state(df, {"name": "series", "start": "first", "stop": "last"})
    return df.withColumn("total", F.col("mean") * F.col("cnt")).drop("mean") if "mean" in df.columns else df


#: From each older format to the next.
MIGRATIONS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {"1.0": ("1.1", _from_1_0)}


def last_version(spark: SparkSession, folder: str) -> dict | None:
    """The marker of the last committed version: its number, format, settings and data folder."""
    marks = [n for n in files.names(spark, f"{folder}/versions") if n.endswith(".json")]
    return json.loads(files.read(spark, f"{folder}/versions/{marks[-1]}")) if marks else None


def load(spark: SparkSession, folder: str) -> DataFrame | None:
    """The last committed state in the present format."""
    mark = last_version(spark, folder)
    if mark is None:
        return None
    df, held = spark.read.parquet(f"{folder}/{mark['data']}"), mark["format"]
    while held != FORMAT:
        if held not in MIGRATIONS:
            raise ValueError(f"states of format {held} can't be read")
        held, step = MIGRATIONS[held]
        df = step(df)
    return df.select(*STATE)


def append(new: DataFrame, folder: str, series: str, order: list[str], time: str, value: str, limit: int, keep_start: int = 0, keep_end: int = 0) -> int:
    """Add points to the last version and commit the next; its number.

    A run that dies leaves a data folder without a marker; two runs at once can't both commit a version.
    """
    spark = new.sparkSession
    settings = [limit, keep_start, keep_end]
    mark, state = last_version(spark, folder), load(spark, folder)
    if mark and mark["settings"] != settings:
        raise ValueError(f"the state was made with limit, start and end {mark['settings']}")
    options = (series, order, time, value, limit, keep_start, keep_end)
    out = state_of(new, *options) if state is None else resumed(state, new, *options)
    number = (mark["version"] if mark else 0) + 1
    data = f"data/{number:08d}-{uuid.uuid4().hex}"
    out.write.parquet(f"{folder}/{data}")
    if not files.publish(spark, f"{folder}/versions/{number:08d}.json", json.dumps({"version": number, "format": FORMAT, "settings": settings, "data": data})):
        raise RuntimeError(f"version {number} was committed by another run")
    return number
