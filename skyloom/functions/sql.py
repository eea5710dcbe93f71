"""The library's expressions as SQL functions of a session: inlined by the optimizer, so a plan has no call and no Python.

    register(spark)
    spark.sql("SELECT sky_readable_duration(seconds) FROM steps")

A function's body is the SQL of its column expression, taken from Spark's own analysis, so each rule is written once.
Table functions are SQL queries over their arguments.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from skyloom import catalog
from skyloom.functions import scaling, text
from skyloom.operators import climatology, metrics, periods, series, splits

PREFIX = "sky_"
_RAISED = "raise_error('USER_RAISED_EXCEPTION', map('errorMessage', "


@dataclass(frozen=True)
class Scalar:
    """Parameters as a schema, and the expression of their columns."""

    parameters: str
    build: Callable[..., Column]
    about: str


SCALARS: dict[str, Scalar] = {
    "normalize": Scalar("x double, low double, high double", scaling.normalize, "x scaled from its range to -1 to 1"),
    "normalize_log": Scalar("x double, low double, high double, log_offset double", scaling.normalize_log, "the logarithm of x scaled to -1 to 1"),
    "denormalize": Scalar("y double, low double, high double", scaling.inverse_normalize, "inverse of normalize"),
    "denormalize_log": Scalar("y double, low double, high double, log_offset double", scaling.inverse_normalize_log, "inverse of normalize_log"),
    "readable_value": Scalar("v double", text.readable_value, "a number as people write it"),
    "readable_duration": Scalar("s double", text.readable_duration, "seconds in the two largest units"),
    "readable_bytes": Scalar("b bigint", text.readable_bytes, "bytes in the largest whole unit"),
    "eta_suffix": Scalar("eta double", metrics.eta_suffix, "what a message says of the time left"),
    "hex_digest": Scalar("t string", text.hex_digest, "first eight hexadecimal digits of the SHA-256 of a text"),
    "batch_path": Scalar("split string, digest string, batch bigint", text.batch_path, "name of a batch's file"),
    "batch_of": Scalar("idx bigint, size bigint", lambda idx, size: F.floor(idx / size).cast("long"), "batch that holds an index"),
    "bucket_of": Scalar("i bigint, n bigint", lambda i, n: series.bucket_of(i, n, 15), "bucket of point i of n in a series of at most 15"),
    "calendar_day": Scalar("ts timestamp_ntz", climatology.calendar_day, "day of the year in a calendar with the 29th of February"),
    "period_start": Scalar("period string", lambda p: periods.decode_period(p)[0], "start of a period YYYYMMDDHH_YYYYMMDDHH"),
    "period_end": Scalar("period string", lambda p: periods.decode_period(p)[1], "end of a period YYYYMMDDHH_YYYYMMDDHH"),
    "compact_hour": Scalar("ts timestamp_ntz", periods.compact_hour, "a time as YYYYMMDDHH"),
    "level_dimension": Scalar("name string, level double", catalog.level_dimension, "level dimension of a variable"),
    "save_index": Scalar("idx bigint", lambda idx: splits.save_index(idx, 64, 32), "file of an item, 64 samples a file and 32 an item"),
}

#: Table functions: parameters, columns and query.
TABLES: dict[str, tuple[str, str, str]] = {
    "split_period": (
        "start_at timestamp_ntz, end_at timestamp_ntz, batch int, step_hours int",
        "period string, first_at timestamp_ntz, last_at timestamp_ntz",
        "SELECT concat_ws('_', date_format(a, 'yyyyMMddHH'), date_format(b, 'yyyyMMddHH')), a, b FROM (SELECT timestampadd(HOUR, k * batch * step_hours, start_at) AS a, timestampadd(HOUR, least(k * batch + batch - 1, timestampdiff(HOUR, start_at, end_at) div step_hours) * step_hours, start_at) AS b"
        " FROM (SELECT explode(CASE WHEN end_at >= start_at THEN sequence(0L, timestampdiff(HOUR, start_at, end_at) div step_hours div batch) END) AS k))",
    ),
    "batches": ("n bigint, size bigint", "batch bigint, first_idx bigint, end_idx bigint", "SELECT k, k * size, least(n, k * size + size) FROM (SELECT explode(CASE WHEN n > 0 THEN sequence(0L, (n - 1) div size) END) AS k)"),
}


def body(spark: SparkSession, scalar: Scalar) -> str:
    """SQL of the expression over its parameters."""
    schema = _parse_datatype_string(scalar.parameters)
    built = spark.createDataFrame([], schema).select(scalar.build(*[F.col(f.name) for f in schema.fields]).alias("value"))
    out = built._jdf.queryExecution().analyzed().expressions().head().child().sql()
    # Spark prints errors with a class that its own SQL doesn't take
    while (at := out.find(_RAISED)) >= 0:
        end, depth = at + len(_RAISED), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(out[end], 0)
            end += 1
        out = f"{out[:at]}raise_error({out[at + len(_RAISED) : end]}{out[end + 1 :]}"
    return out


def register(spark: SparkSession) -> list[str]:
    """Create all functions in the session; their names."""
    for name, scalar in SCALARS.items():
        about = scalar.about.replace("'", "''")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{name}({scalar.parameters}) COMMENT '{about}' RETURN {body(spark, scalar)}")
    for name, (parameters, columns, query) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{name}({parameters}) RETURNS TABLE({columns}) RETURN {query}")
    return [PREFIX + n for n in (*SCALARS, *TABLES)]
