"""Small files of bookkeeping in any store that Spark reaches, through its own file system interface, on the driver.

Hadoop's interface to local disks looks before it creates, so two callers may both succeed; there the operating
system is asked to create or link a file only if there is none.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def create(spark: SparkSession, path: str, text: str = "") -> bool:
    """Create a file if there is none; False if another one was first. One of several callers succeeds."""
    fs, where = _at(spark, path)
    if fs.getScheme() == "file":
        local = where.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            with open(local, "x") as f:
                f.write(text)
        except FileExistsError:
            return False
        return True
    try:
        out = fs.create(where, False)
    except Exception as e:  # a Java exception of the store; only "already there" is an answer
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def read(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """A file that appears whole: written beside its place and renamed; False if one is there already."""
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    create(spark, beside, text)
    fs, where = _at(spark, path)
    _, source = _at(spark, beside)
    if fs.getScheme() == "file":
        try:
            os.link(source.toUri().getPath(), where.toUri().getPath())
            done = True
        except FileExistsError:
            done = False
        fs.delete(source, False)
        return done
    done = not fs.exists(where) and fs.rename(source, where)
    if not done:
        fs.delete(source, False)
    return done


def age(spark: SparkSession, path: str) -> float | None:
    """Seconds since a file was written; None where there is none."""
    fs, where = _at(spark, path)
    try:
        written = fs.getFileStatus(where).getModificationTime()
    except Exception as e:
        if "FileNotFound" in str(e):
            return None
        raise
    return spark.sparkContext._jvm.java.lang.System.currentTimeMillis() / 1000 - written / 1000


def touch(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.setTimes(where, spark.sparkContext._jvm.java.lang.System.currentTimeMillis(), -1)


def delete(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.delete(where, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    fs, where = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []
