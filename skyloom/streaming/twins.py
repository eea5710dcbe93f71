"""Structured Streaming twins of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from skyloom.operators import metrics


def append_bounded(buckets: list, points: list[tuple[float, float]], limit: int, keep_start: int = 0, keep_end: int = 0) -> int:
    """Append points in time order, joining neighbours in pairs beyond the limit; returns how many came out of order and were left out."""
    dropped = 0
    for time, value in points:
        if buckets and time <= buckets[-1][1]:
            dropped += 1
            continue
        buckets.append((time, time, 1, value))
        if len(buckets) > limit:
            end = len(buckets) - keep_end
            middle = buckets[keep_start:end]
            joined = []
            for i in range(0, len(middle) - 1, 2):
                a, b = middle[i], middle[i + 1]
                n = a[2] + b[2]
                joined.append((a[0], b[1], n, (a[3] * a[2] + b[3] * b[2]) / n))
            joined += middle[len(joined) * 2 :]
            buckets[:] = buckets[:keep_start] + joined + buckets[end:]
    return dropped


def bounded_series(stream: DataFrame, series: str, time: str, value: str, limit: int, keep_start: int = 0, keep_end: int = 0) -> DataFrame:
    """Update-mode stream of each series' buckets; out-of-order points are counted and left out. State is at most ``limit`` buckets a series."""
    out = T.StructType([T.StructField("series", T.StringType()), T.StructField("bucket", T.LongType()), T.StructField("time", T.DoubleType()), T.StructField("cnt", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("dropped", T.LongType())])
    kept = T.StructType([T.StructField("lo", T.ArrayType(T.DoubleType())), T.StructField("hi", T.ArrayType(T.DoubleType())), T.StructField("cnt", T.ArrayType(T.LongType())), T.StructField("value", T.ArrayType(T.DoubleType())), T.StructField("dropped", T.LongType())])

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buckets, dropped = [], 0
        if state.exists:
            lo, hi, cnt, val, dropped = state.get
            buckets = list(zip(lo, hi, cnt, val, strict=True))
        rows = pd.concat(list(frames)).sort_values("t", kind="stable")
        dropped += append_bounded(buckets, list(zip(rows["t"], rows["v"], strict=True)), limit, keep_start, keep_end)
        columns = [list(c) for c in zip(*buckets, strict=True)] or [[], [], [], []]
        state.update((*columns, dropped))
        yield pd.DataFrame({"series": key[0], "bucket": range(len(buckets)), "time": [(b[0] + b[1]) / 2 for b in buckets], "cnt": [b[2] for b in buckets], "value": [b[3] for b in buckets], "dropped": dropped})

    src = stream.select(F.col(series).cast("string").alias("series"), F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("v"))
    return src.groupBy("series").applyInPandasWithState(update, out, kept, "update", GroupStateTimeout.NoTimeout)


class _Limiter(StatefulProcessor):
    """An identifier's count, the time it last let through and the time it was last seen, until nothing was seen for ``forget`` seconds."""

    def __init__(self, delay: float, tolerance: int, forget: float):
        self.rule = (delay, tolerance, forget)

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("limit", "n long, last double, seen double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = tuple(self.held.get()) if self.held.exists() else metrics.FRESH
        for r in sorted(rows, key=lambda r: r["order"]):
            if r["s"] is not None and state[2] is not None and r["s"] < state[2]:
                # behind what was decided already: told apart, never judged
                yield Row(key=key[0], order=r["order"], emitted=None, late=True)
                continue
            ok, state = metrics.admit(state, r["s"], *self.rule)
            yield Row(key=key[0], order=r["order"], emitted=ok, late=False)
        self.held.update(state)
        if state[2] is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int((state[2] + self.rule[2]) * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limited_stream(stream: DataFrame, key: str, order: str, time: str, delay: float, tolerance: int, forget: float, watermark: str = "0 seconds") -> DataFrame:
    """Append-mode stream of messages: whether each passes, by the rule of ``metrics.rate_limited`` with the same ``forget``.

    ``time`` is a timestamp, and messages come in its order but for ``watermark``. State is three numbers an identifier and
    goes ``forget`` seconds after its last message, by an event-time timer, so it grows with the identifiers of that time, not
    with all. Messages behind their identifier's last one come out with ``late`` and without a decision; those behind the watermark are
    left out by Spark. Needs the RocksDB state store.
    """
    out = T.StructType([T.StructField("key", T.StringType()), T.StructField("order", T.LongType()), T.StructField("emitted", T.BooleanType()), T.StructField("late", T.BooleanType())])
    seconds = F.unix_micros(F.col(time).cast("timestamp")).cast("double") / F.lit(1e6)
    src = stream.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("order"), F.col(time).cast("timestamp").alias("at"), seconds.alias("s")).withWatermark("at", watermark)
    return src.groupBy("key").transformWithState(statefulProcessor=_Limiter(delay, tolerance, forget), outputStructType=out, outputMode="Append", timeMode="EventTime")


def running_minimum_stream(stream: DataFrame, metric: str, value: str) -> DataFrame:
    """Update-mode least value of each metric: a built-in aggregate, state of one number a metric."""
    return stream.groupBy(metric).agg(F.min(value).alias("min_value"), F.count(F.lit(1)).alias("seen"))


def run_available(query: DataFrame, mode: str, checkpoint: str, sink: str) -> None:
    """Process what is there and stop; Parquet for append mode, the last state of an update stream by batch for others."""
    writer = query.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", sink).start().awaitTermination()
    else:
        writer.foreachBatch(lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(sink)).start().awaitTermination()
