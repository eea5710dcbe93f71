"""Periods of time steps: decoding, splitting and assembly of time stamps."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.operators.splits import dealt_by_key


def decode_period(text: Column) -> tuple[Column, Column]:
    """Start and end of ``YYYYMMDDHH_YYYYMMDDHH``; other lengths raise when the result is read, null stays null."""

    def part(i: int) -> Column:
        p = F.split_part(text, F.lit("_"), F.lit(i))
        return F.when(text.isNull(), None).when(F.length(p) == 10, F.to_timestamp_ntz(p, F.lit("yyyyMMddHH"))).otherwise(F.raise_error(F.concat(F.lit("no period: "), text)).cast("timestamp_ntz"))

    return part(1), part(2)


def split_period(spark: SparkSession, start: datetime, end: datetime, batch: int, step: timedelta, clamp: bool = True) -> DataFrame:
    """period, first, last: batches of ``batch`` steps from start to end.

    Clamped, the last batch ends at the last step not after the end. Unclamped, it ends early only if a step meets
    the end exactly, and may reach up to ``batch - 1`` steps beyond it.
    """
    seconds = int(step.total_seconds())
    if batch < 1 or seconds < 1:
        raise ValueError("a batch has at least one step, and a step at least one second")
    span = int((end - start).total_seconds())
    periods = span // (seconds * batch) + 1 if span >= 0 else 0
    last_step = span // seconds
    hit = span % seconds == 0
    p = spark.range(periods).select(F.col("id"), (F.col("id") * batch).alias("a"), (F.col("id") * batch + batch - 1).alias("b"))
    if clamp or hit:
        p = p.withColumn("b", F.least("b", F.lit(last_step)))
    at = lambda k: F.timestamp_add("SECOND", (F.col(k) * seconds), F.lit(start).cast("timestamp_ntz"))
    out = p.select("id", at("a").alias("first"), at("b").alias("last"))
    name = F.concat_ws("_", F.date_format("first", "yyyyMMddHH"), F.date_format("last", "yyyyMMddHH"))
    return out.select(name.alias("period"), "first", "last")


def split_spans(spans: DataFrame, start: str, end: str, batch: int, step: timedelta) -> DataFrame:
    """``split_period``, clamped, for a table of spans: period, first and last of every batch of each; none where the end is before the start."""
    seconds = int(step.total_seconds())
    if batch < 1 or seconds < 1:
        raise ValueError("a batch has at least one step, and a step at least one second")
    steps = F.floor(F.timestamp_diff("SECOND", F.col(start), F.col(end)) / F.lit(seconds)).cast("long")
    at = lambda k: F.timestamp_add("SECOND", k * seconds, F.col(start))
    numbered = spans.where(F.col(end) >= F.col(start)).withColumn("_steps", steps).withColumn("_batch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_steps") / F.lit(batch)))))
    out = numbered.withColumn("first", at(F.col("_batch") * batch)).withColumn("last", at(F.least(F.col("_batch") * batch + (batch - 1), F.col("_steps"))))
    name = F.concat_ws("_", F.date_format("first", "yyyyMMddHH"), F.date_format("last", "yyyyMMddHH"))
    return out.withColumn("period", name).drop("_steps", "_batch")


def assemble_timestamp(year: Column, month: Column, day: Column, hour: Column) -> Column:
    return F.make_timestamp_ntz(year, month, day, hour, F.lit(0), F.lit(0))


def compact_hour(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHH")


def forecast_hours(df: DataFrame, ts: str, hours: list[int], start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Rows at given hours of the day and, if set, from start to end; the date range reaches the scan."""
    out = df
    if start is not None:
        out = out.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.where(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    return out.where(F.hour(ts).isin(hours))


def pair_as_of(fine: DataFrame, coarse: DataFrame, fine_time: str, coarse_time: str, order: str, within: int) -> DataFrame:
    """Every fine row with the ``order`` and time of the latest coarse row not after it and at most ``within`` seconds before; nulls without one.

    Of coarse rows at one time the greatest ``order`` counts. Both tables are dealt together into even ranges of time, whatever
    the times are; within a range the last coarse row is carried along, and a table of one row a range carries it on.
    """
    micros = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c))
    marks = coarse.where(F.col(coarse_time).isNotNull()).groupBy(F.col(coarse_time).alias("_t")).agg(F.max(order).alias("_o"))
    rows = fine.select(F.struct("*").alias("_row"), F.col(fine_time).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).alias("_mark"))
    both = rows.unionByName(marks.select(F.lit(None).alias("_row"), "_t", F.lit(0).alias("_kind"), F.struct("_t", "_o").alias("_mark")))
    dealt = dealt_by_key(both, ["_t", "_kind"])
    # one row a range
    ends = dealt.groupBy("_slot").agg(F.max("_mark").alias("_end"))
    carried = ends.select(F.col("_slot"), F.max("_end").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    seen = F.last("_mark", ignorenulls=True).over(Window.partitionBy("_slot").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    met = dealt.withColumn("_seen", seen).where("_kind = 1").join(F.broadcast(carried), "_slot").withColumn("_found", F.coalesce("_seen", "_before"))
    near = micros("_t") - micros("_found._t") <= within * 1_000_000
    return met.select("_row.*", F.when(near, F.col("_found._o")).alias(order), F.when(near, F.col("_found._t")).alias(f"paired_{coarse_time}"))
