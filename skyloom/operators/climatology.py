"""Means by day of the year and hour over a window of days that wraps at the year's end, and anomalies from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of the calendar: that of leap years, so that a date has one day in all years; the 29th of February is day 60.
DAYS = 366


def calendar_day(ts: Column) -> Column:
    """Day 1 to 366 of a date, as in leap years: the 1st of March is day 61 always."""
    return F.dayofyear(F.make_date(F.lit(2024), F.month(ts), F.dayofmonth(ts)))


def climatology(df: DataFrame, keys: list[str], ts: str, value: str, days: int, scale: int = 6) -> DataFrame:
    """keys, day, hour, mean and number of the values within ``days`` days before and after, around the year's end.

    Values are summed once by day, exactly, as decimals of ``scale`` digits; a window is a difference of two running sums, so its
    width costs nothing. Days and hours without a value in their window have a null mean; nulls aren't counted.
    """
    if not 0 <= days < DAYS // 2:
        raise ValueError("a window is shorter than the year")
    exact = F.col(value).cast(f"decimal(28,{scale})")
    daily = df.groupBy(*keys, F.hour(ts).alias("hour"), calendar_day(F.col(ts)).alias("day")).agg(F.sum(exact).cast(f"decimal(38,{scale})").alias("_s"), F.count(value).alias("_n"))
    series = daily.select(*keys, "hour").distinct()
    # three years in a row, so that no window meets the end: at most 366 days of each key and hour are held
    dense = series.select(*keys, "hour", F.explode(F.sequence(F.lit(1), F.lit(DAYS))).alias("day"))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*keys, "hour", "day")]
    filled = dense.alias("d").join(daily.alias("s"), same, "left").select("d.*", F.coalesce("_s", F.lit(0).cast(f"decimal(38,{scale})")).alias("_s"), F.coalesce("_n", F.lit(0)).alias("_n"))
    ring = filled.withColumn("_at", F.explode(F.array(F.col("day") - DAYS, F.col("day"), F.col("day") + DAYS)))
    near = Window.partitionBy(*keys, "hour").orderBy("_at")
    run = ring.withColumns({f"_r{c}": F.sum(c).over(near.rowsBetween(Window.unboundedPreceding, 0)) for c in ("_s", "_n")})
    window = {name: F.lead(f"_r{c}", days).over(near) - F.lag(f"_r{c}", days + 1).over(near) for name, c in (("_sum", "_s"), ("count", "_n"))}
    met = run.withColumns(window).where(F.col("_at").between(1, DAYS))
    return met.select(*keys, "hour", "day", F.try_divide(F.col("_sum").cast("double"), F.col("count").cast("double")).alias("mean"), "count")


def anomalies(df: DataFrame, means: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """The rows with ``anomaly``: value less the mean of their keys, day and hour."""
    named = means.select(*[F.col(c).alias(f"_m_{c}") for c in (*keys, "hour", "day")], F.col("mean").alias("_mean"))
    same = (F.hour(ts) == F.col("_m_hour")) & (calendar_day(F.col(ts)) == F.col("_m_day"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_m_{k}"))
    return df.join(named, same, "left").withColumn("anomaly", F.col(value) - F.col("_mean")).drop("_mean", "_m_hour", "_m_day", *[f"_m_{k}" for k in keys])
