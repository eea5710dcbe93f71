"""Retention that is carried out: files of a plan are deleted by tasks, with a tombstone before and an audit after.

First the plan is written as tombstones, so that a run that dies can be finished and what it wanted is known; then
tasks delete the files and say for each what happened; the audit is the table of that. A protected file is never
in the tombstones, whatever the plan says, and a file that is newer than the plan knew stays. A rerun
finds what was deleted already and changes nothing.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators.files import excluding
from skyloom.plans.config import check_safe
from skyloom.sources.shared import new_path

#: Files of a task.
PER_TASK = 1000


def delete_files(batches):
    """For each tombstone: deleted, gone already, kept because it was changed since, or failed, with the error."""
    import pyarrow.fs as pafs

    from skyloom.sources.archives import store

    for batch in batches:
        outcomes, errors = [], []
        for path, mtime in zip(batch.column("path").to_pylist(), batch.column("mtime").to_pylist(), strict=True):
            try:
                fs, inner = store(path)
                info = fs.get_file_info(inner)
                if info.type == pafs.FileType.NotFound:
                    outcome = "gone"
                elif info.type != pafs.FileType.File:
                    outcome = "no file"
                elif mtime is not None and info.mtime_ns // 1_000_000 > mtime:
                    outcome = "changed"
                else:
                    fs.delete_file(inner)
                    outcome = "deleted"
                error = None
            except Exception as e:  # one file's failure is that file's outcome
                outcome, error = "failed", f"{type(e).__name__}: {e}"
            outcomes.append(outcome)
            errors.append(error)
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(outcomes, pa.string()), pa.array(errors, pa.string())], names=["path", "outcome", "error"])


def purge(plan: DataFrame, path: str = "path", mtime: str = "mtime", protected: DataFrame | None = None, folder: str | None = None, within: tuple[str, str] | None = None) -> tuple[DataFrame, str]:
    """Carry out a retention plan; the audit (path, outcome, error) and the folder that keeps it with the tombstones.

    ``protected`` has paths that stay. ``within`` is a folder and a pattern that must be safe to delete in; files elsewhere
    are refused before any is deleted.
    """
    spark = plan.sparkSession
    folder = folder or new_path(spark, "purge")
    asked = excluding(plan, protected.select(F.col(path)).distinct(), [path]) if protected is not None else plan
    marks = asked.where(F.col(path).isNotNull()).groupBy(F.col(path).alias("path")).agg(F.max(F.unix_millis(F.col(mtime).cast("timestamp"))).alias("mtime"))
    if within is not None:
        check_safe(*within)
        root = within[0].rstrip("/") + "/"
        local = F.regexp_replace("path", "^file:/+", "/")
        marks = marks.withColumn("path", F.when(local.startswith(root) & ~local.contains("/../"), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("not in the folder: "), F.col("path")))))
    marks.write.parquet(f"{folder}/tombstones")
    return finish(spark, folder), folder


def finish(spark: SparkSession, folder: str) -> DataFrame:
    """Delete what the tombstones name and write the audit; again after a run that died, as often as needed."""
    marks = spark.read.parquet(f"{folder}/tombstones")
    tasks = max(1, -(-marks.count() // PER_TASK))
    dealt = marks.repartition(tasks, F.xxhash64("path"))
    dealt.mapInArrow(delete_files, "path string, outcome string, error string").write.mode("append").parquet(f"{folder}/audit")
    return audit(spark, folder)


def audit(spark: SparkSession, folder: str) -> DataFrame:
    """What happened to each file in the end: of several runs or attempts, deleted before gone."""
    order = F.when(F.col("outcome") == "deleted", 0).when(F.col("outcome") == "gone", 1).when(F.col("outcome") == "failed", 3).otherwise(2)
    return spark.read.parquet(f"{folder}/audit").groupBy("path").agg(F.min_by(F.struct("outcome", "error"), order).alias("r")).select("path", "r.outcome", "r.error")
