"""Stored samples: partitioned tables of batches, read-through caches, manifests of outputs."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.catalog import columns, with_variable
from skyloom.functions.scaling import by_variable
from skyloom.sources.archives import write_archives
from skyloom.sources.cache import committed, kept


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table is there, asked of the store that Spark reads."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path).schema  # noqa: B018
    except AnalysisException:
        return False
    return True


def save_batches(df: DataFrame, path: str) -> None:
    """Write samples in files of many batches each, sorted by split, batch and position; what was committed before stays.

    Readers find a batch by the statistics of row groups and pages, so there is no folder or file for each. A write that
    crashed is done again, as there is a marker (``cache``).
    """
    kept(df.sparkSession, path, lambda: df.repartitionByRange("split", "batch_id").sortWithinPartitions("split", "batch_id", "pos"))


def _stored(spark: SparkSession, path: str) -> DataFrame:
    df = committed(spark, path)
    if df is None:
        raise FileNotFoundError(path)
    return df


def load_batch(spark: SparkSession, path: str, split: str, batch_id: int, first: int, last: int, keys: list[str] | None = None) -> DataFrame:
    """Positions first to last - 1 of a stored batch: row groups are pruned by split and batch, columns by keys."""
    df = _stored(spark, path).where((F.col("split") == split) & (F.col("batch_id") == batch_id) & (F.col("pos") >= first) & (F.col("pos") < last))
    return df.select("pos", *keys) if keys else df


def load_item(spark: SparkSession, path: str, split: str, idx: int, save: int, built_in: int, keys: list[str] | None = None) -> DataFrame:
    """The positions of one item: a single one if the source isn't batched (0), else ``built_in`` of its file of ``save``."""
    per = save if built_in == 0 else save // built_in
    first = idx % per * max(1, built_in)
    return load_batch(spark, path, split, idx // per, first, first + max(1, built_in), keys)


def scan_batch(spark: SparkSession, path: str, split: str, batch_id: int, keys: list[str] | None = None) -> DataFrame:
    """A whole stored batch."""
    df = _stored(spark, path).where((F.col("split") == split) & (F.col("batch_id") == batch_id))
    return df.select("pos", *keys) if keys else df


def project(df: DataFrame, keys: list[str], kept: tuple[str, ...] = ()) -> DataFrame:
    """The columns asked for by key, in that order: a registered column builder under the key goes before a column of the name."""
    return df.select(*kept, *[columns.build(k).alias(k) if k in columns else F.col(k) for k in keys])


def first_samples(df: DataFrame, order: str, most: int | None) -> DataFrame:
    """The first ``most`` samples by order, all without a limit; a sort of at most so many rows a task."""
    return df if most is None else df.orderBy(order).limit(most)


def metadata_table(df: DataFrame) -> DataFrame:
    """column, attribute and value (as JSON) of all column metadata: a row an attribute."""
    rows = [(f.name, k, json.dumps(v)) for f in df.schema.fields for k, v in sorted(f.metadata.items())]
    return df.sparkSession.createDataFrame(rows, "column string, attribute string, value string").coalesce(1)


def column_ranges(df: DataFrame) -> DataFrame:
    """A row a numeric column: its number of values, the lowest and the highest."""
    numeric = [c for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    row = df.agg(*[f(F.col(c).cast("double") if f is not F.count else F.col(c)).alias(f"{name}_{i}") for i, c in enumerate(numeric) for name, f in (("n", F.count), ("lowest", F.min), ("highest", F.max))])
    each = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{name}_{i}").alias(name) for name in ("n", "lowest", "highest")]) for i, c in enumerate(numeric)])
    return row.select(F.inline(each))


def read_through(spark: SparkSession, folder: str, digest: str, compute: Callable[[], DataFrame], skip_load: bool = False, only_saved: bool = False) -> DataFrame:
    """The table committed under a digest; where there is none one caller computes it, or it is refused with ``only_saved``.

    ``skip_load`` gives the saved table's schema without rows. What a crashed write leaves is never read (``cache``).
    """
    path = f"{folder.rstrip('/')}/{digest}"
    if only_saved and committed(spark, path) is None:
        raise FileNotFoundError(path)
    saved = kept(spark, path, compute)
    return saved.limit(0) if skip_load else saved


def with_fixed(df: DataFrame, fixed: DataFrame) -> DataFrame:
    """Every sample with the one row of sample-independent data; more rows are refused when read."""
    held = fixed.limit(2).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("*")).alias("row"))
    one = held.select(F.when(F.col("n") == 1, F.col("row")).otherwise(F.raise_error(F.lit("fixed data have one row"))).alias("row")).select("row.*")
    return df.crossJoin(F.broadcast(one))


def output_manifest(samples: DataFrame, ts: str, channels: str, names: list[str], h0: str = "h0", w0: str = "w0", upscale: str = "use_upscale") -> DataFrame:
    """A row a sample and output channel: variable, file path and the values in physical units.

    ``channels`` is an array of channels, each an array of scaled values.
    """
    named = F.array(*map(F.lit, names))
    rows = samples.select("*", F.posexplode(channels).alias("channel", "scaled")).withColumn("variable", F.element_at(named, F.col("channel") + 1))
    known = with_variable(rows, "variable", ("normalize_min", "normalize_max", "log_normalize", "log_offset"))
    path = F.concat(F.col("variable"), F.lit("/"), F.date_format(ts, "yyyyMMddHH"), F.lit("_"), F.col(h0).cast("string"), F.lit("_"), F.col(w0).cast("string"), F.when(F.col(upscale) == 1, "_hrdps_upscale").otherwise(""), F.lit(".nc"))
    return known.withColumn("path", path).withColumn("values", F.transform("scaled", lambda y: by_variable(y.cast("double")))).drop("scaled", "normalize_min", "normalize_max", "log_normalize", "log_offset")


def write_outputs(manifest: DataFrame, folder: str) -> None:
    manifest.write.mode("append").partitionBy("variable").parquet(folder)


def write_output_files(manifest: DataFrame, folder: str, order: str, shapes: dict[str, list[int]] | None = None) -> None:
    """The files that a manifest names: a NetCDF file a path with the values of its samples by ``order``, committed together.

    Samples that share a path are the first axis of its file.
    """
    rows = manifest.select(F.col("path").alias("file"), F.col(order).alias("pos"), F.col(order), F.col("values"))
    write_archives(rows, folder, shapes)


def cf_metadata(df: DataFrame, attributes: dict[str, dict]) -> DataFrame:
    """Columns with CF attributes (units, fill value, compression) as column metadata."""
    for name, values in attributes.items():
        df = df.withMetadata(name, values)
    return df


def text_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file and text of whole files, for lines with reliable numbers."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def log_files(spark: SparkSession, source: str | list[str], pattern: str = "*.log") -> DataFrame:
    """file and text of logs: those of a folder, of a list of files, or of the files that JSON manifests name as ``log_file``."""
    if isinstance(source, list):
        return text_files(spark, source)
    if source.endswith(".json"):
        # a row a log; manifests are few
        named = [r["log_file"] for r in spark.read.json(source, multiLine=True).select("log_file").where("log_file is not null").distinct().orderBy("log_file").collect()]
        return text_files(spark, named) if named else spark.createDataFrame([], "file string, text string")
    return text_files(spark, f"{source.rstrip('/')}/{pattern}")


def save_weights(spark: SparkSession, folder: str, name: str, networks: dict[str, dict]) -> None:
    """Weights of networks saved together: a row an array, with its network, name, shape and row-major values. A name is written once."""
    rows = [(n, k, list(a.shape), a.ravel().astype(float).tolist()) for n, arrays in networks.items() for k, a in arrays.items()]
    spark.createDataFrame(rows, "network string, name string, shape array<int>, values array<double>").write.mode("errorifexists").partitionBy("network").parquet(f"{folder.rstrip('/')}/{name}")


def load_weights(spark: SparkSession, path: str, network: str | None = None) -> DataFrame:
    """The arrays of a checkpoint, of one network or of all."""
    df = spark.read.parquet(path)
    return df if network is None else df.where(F.col("network") == network)


def file_listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, mtime and length of files that match, without their content; sorted by path only where it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", F.col("modificationTime").alias("mtime"), "length")


def archive_arrays(spark: SparkSession, folder: str, key: str, pattern: str = "*.npz") -> DataFrame:
    """Import of NumPy archives: path, shape and row-major values of one array of each file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")

    def read(batches):
        import io

        import numpy as np
        import pandas as pd

        for pdf in batches:
            arrays = [np.load(io.BytesIO(c), allow_pickle=False)[key] for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "shape": [list(a.shape) for a in arrays], "values": [a.ravel().astype("float64").tolist() for a in arrays]})

    return files.mapInPandas(read, "path string, shape array<int>, values array<double>")
