"""Run metrics: minima, running minima, iteration counts, remaining time and rate limits."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.text import readable_duration
from skyloom.operators.splits import dealt_by_key, rank_within, with_earlier


def minima(df: DataFrame, metric: str, value: str, iteration: str, tracked: DataFrame | None = None) -> DataFrame:
    """The least value of each metric and its first iteration; with ``tracked``, of those metrics only.

    NaN isn't below anything: a NaN in the first iteration stays the minimum.
    """
    src = df if tracked is None else df.join(tracked.select(metric).distinct(), metric, "left_semi")
    ordered = F.struct(F.when(F.isnan(value), F.lit(float("inf"))).otherwise(F.col(value)).alias("v"), F.col(iteration).alias("i"))
    first = F.min_by(F.struct(F.col(value).alias("v"), F.col(iteration).alias("i")), iteration)
    found = src.groupBy(metric).agg(F.min(ordered).alias("_least"), first.alias("_first"))
    stuck = F.isnan("_first.v")
    return found.select(metric, F.when(stuck, F.col("_first.v")).otherwise(F.col("_least.v")).alias("min_value"), F.when(stuck, F.col("_first.i")).otherwise(F.col("_least.i")).alias("min_iteration"))


def improved(before: DataFrame, now: DataFrame, metric: str, value: str, listed: DataFrame | None = None) -> DataFrame:
    """One row: whether any metric (of those listed) of ``now`` is below its least value so far; a metric without one improves."""
    least = before.groupBy(metric).agg(F.min(value).alias("_least"))
    asked = now if listed is None else now.join(listed.select(metric).distinct(), metric, "left_semi")
    better = F.coalesce(F.col(value) < F.col("_least"), F.col(value).isNotNull())
    return asked.join(least, metric, "left").agg(F.coalesce(F.max(better), F.lit(False)).alias("any_improved"))


def running_minimum(df: DataFrame, metric: str, order: list[str], value: str, spread: bool = False) -> DataFrame:
    """Least value before each row and whether the row is strictly below it (the first row is).

    Each metric is read by one task; with ``spread`` long ones are dealt to many, at the cost of writing the rows once.
    """
    if spread:
        met = with_earlier(dealt_by_key(df, [metric, *order]), [metric], {"_least": F.min(value)}, {"_before": lambda own: F.min("_least").over(own.rowsBetween(Window.unboundedPreceding, -1))})
        inside = F.min(value).over(Window.partitionBy("_slot", metric).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
        least = met.withColumn("previous_min", F.least("_before", inside)).drop("_slot", "_at", "_before")
        return least.withColumn("improved", F.coalesce(F.col(value) < F.col("previous_min"), F.lit(True)))
    w = Window.partitionBy(metric).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("previous_min", F.min(value).over(w)).withColumn("improved", F.coalesce(F.col(value) < F.col("previous_min"), F.lit(True)))


def iteration_counts(df: DataFrame, order: list[str], session: str) -> DataFrame:
    """Running counts of iterations, in all and since each session's start, for one sequence a ``loop``."""
    counted = rank_within(df, ["loop"], order, "lifetime", "_n").drop("_n")
    counted = rank_within(counted, ["loop", session], order, "since_restart", "_n").drop("_n")
    return counted.withColumns({c: F.col(c) + 1 for c in ("lifetime", "since_restart")})


def remaining_time(df: DataFrame, key: str, order: list[str], seconds: str, expected: int, spread: bool = False) -> DataFrame:
    """``eta``: elapsed/(n - 1) times the calls left; null at the first call, 0 when done.

    Each key is read by one task; with ``spread`` long ones are dealt to many, at the cost of writing the rows once.
    """
    if spread:
        ends = {"_rows": F.count(F.lit(1)), "_low": F.min("_at"), "_first": F.min_by(seconds, "_at")}
        earlier = {"_before": lambda own: F.sum("_rows").over(own) - F.col("_rows"), "_low": lambda own: F.col("_low"), "_began": lambda own: F.first("_first").over(own)}
        met = with_earlier(dealt_by_key(df, [key, *order]), [key], ends, earlier)
        n = F.col("_before") + F.col("_at") - F.col("_low") + 1
        eta = F.when(n == 1, None).when(n >= expected, F.lit(0.0)).otherwise(F.try_divide(F.col(seconds) - F.col("_began"), (n - 1).cast("double")) * (F.lit(expected) - n))
        return met.withColumn("call", n).withColumn("eta", eta).drop("_slot", "_at", "_before", "_low", "_began")
    w = Window.partitionBy(key).orderBy(*order)
    n = F.row_number().over(w)
    elapsed = F.col(seconds) - F.first(seconds).over(w)
    return df.withColumn("call", n.cast("long")).withColumn("eta", F.when(n == 1, None).when(n >= expected, F.lit(0.0)).otherwise(F.try_divide(elapsed, (n - 1).cast("double")) * (F.lit(expected) - n)))


def eta_suffix(eta: Column) -> Column:
    """What a message ends with: the time left in words, "unknown" at the first call (null) and "done" at the end (0 or less)."""
    shown = F.when(eta.isNull(), "unknown").when(eta <= 0, "done").otherwise(readable_duration(eta))
    return F.concat(F.lit(" (ETA: "), shown, F.lit(")"))


#: State of an identifier without messages: how many passed, when the last one passed, when one was last seen.
FRESH = (0, None, None)


def admit(state: tuple, s: float | None, delay: float, tolerance: int, forget: float | None = None) -> tuple[bool, tuple]:
    """Whether a message at ``s`` seconds passes, and the state after it; the rule of batches and streams.

    A message without a time passes. After ``forget`` seconds without a message an identifier is as good as new.
    """
    n, last, seen = state
    if forget is not None and None not in (s, seen) and s - seen >= forget:
        n, last = 0, None
    ok = n < tolerance or last is None or s is None or not s - last < delay
    return ok, (n + ok, s if ok else last, seen if s is None else s)


def rate_limited(df: DataFrame, key: str, order: str, seconds: str, delay: float, tolerance: int, forget: float | None = None) -> DataFrame:
    """Whether each message of an identifier passes: the first ``tolerance`` do, later ones only ``delay`` after the last that passed.

    With ``forget`` an identifier starts anew after so many seconds without a message. Each message depends on those before
    it, so an identifier's messages are read in order by one task; it keeps three numbers for it, however many messages there are.
    """
    src = df.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(seconds).cast("double").alias("s"))
    kinds = {f.name: f.dataType.simpleString() for f in src.schema.fields}

    def run(batches):
        now, state = object(), FRESH
        for batch in batches:
            passed = []
            for own, s in zip(batch.column("key").to_pylist(), batch.column("s").to_pylist(), strict=True):
                if own != now:
                    now, state = own, FRESH
                ok, state = admit(state, s, delay, tolerance, forget)
                passed.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("order"), pa.array(passed, pa.bool_())], names=["key", "order", "emitted"])

    told = src.repartition("key").sortWithinPartitions("key", "order", "s").mapInArrow(run, f"key {kinds['key']}, order {kinds['order']}, emitted boolean")
    return told.select(F.col("key").alias(key), F.col("order").alias(order), "emitted")


def first_held_back(limited: DataFrame, key: str, order: str) -> DataFrame:
    """The one message at which a single warning says that messages are left out: the first held back, of all identifiers; no row if there is none."""
    return limited.where(~F.col("emitted")).select(order, key).orderBy(order, key).limit(1)


def tail_part(df: DataFrame, metric: str, order: list[str], fraction: float | None = None, number: int | None = None) -> DataFrame:
    """The last part of each series by fraction of its rows (rounded up) or by number; no task holds a series alone."""
    ranked = rank_within(df, [metric], order, "_i", "_n")
    limit = F.lit(number) if fraction is None else F.ceil(F.col("_n") * F.lit(fraction))
    return ranked.where(F.col("_n") - F.col("_i") <= limit).select(*df.columns)
