"""Streams with state that expires: equal to batches, bounded, and late messages told apart."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skyloom.operators import metrics
from skyloom.streaming import twins

START = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_limiter_forgets_in_stream_and_batch(rocks, tmp_path):
    """Six files of an hour, each with identifiers of its own and one that is there always; state holds those of the last hour."""
    spark, rows = rocks, []
    for hour in range(6):
        for i in range(40):
            at = START + timedelta(hours=hour, seconds=60 * i)
            rows.append((f"h{hour}-{i % 10}", len(rows), at))
            rows.append(("always", len(rows), at + timedelta(seconds=1)))
            if i == 20 and hour % 2:
                rows += [("rare", len(rows) + k, at + timedelta(seconds=2 + 10 * k)) for k in range(2)]
    for hour in range(6):
        lo, hi = START + timedelta(hours=hour), START + timedelta(hours=hour + 1)
        part = [r for r in rows if lo <= r[2] < hi]
        spark.createDataFrame(part, "k string, o long, t timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{hour}")
    stream = spark.readStream.schema("k string, o long, t timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = twins.rate_limited_stream(stream, "k", "o", "t", 130.0, 2, 5400.0)
    query = out.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/o").start()
    query.awaitTermination()
    got = {r.order: r.emitted for r in spark.read.parquet(f"{tmp_path}/o").collect()}
    batch = spark.createDataFrame(rows, "k string, o long, t timestamp").withColumn("s", F.unix_micros("t") / 1e6)
    want = {r.o: r.emitted for r in metrics.rate_limited(batch, "k", "o", "s", 130.0, 2, 5400.0).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)
    assert want != {r.o: r.emitted for r in metrics.rate_limited(batch, "k", "o", "s", 130.0, 2).collect()}
    # identifiers in all: 62; those of at most two hours and the file at work are held
    held = [p["stateOperators"][0]["customMetrics"].get("numValueStateVars") is not None and p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(held) >= 6 and max(held[3:]) <= 4 * 33


def test_late_messages_are_told_apart(rocks, tmp_path):
    spark = rocks
    files = [[("a", 1, 0), ("a", 2, 500)], [("a", 3, 400), ("a", 4, 600)]]
    for i, part in enumerate(files):
        spark.createDataFrame([(k, o, START + timedelta(seconds=s)) for k, o, s in part], "k string, o long, t timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("k string, o long, t timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    twins.run_available(twins.rate_limited_stream(stream, "k", "o", "t", 50.0, 1, 9000.0, "10 minutes"), "append", f"{tmp_path}/c", f"{tmp_path}/o")
    assert sorted((r.order, r.emitted, r.late) for r in spark.read.parquet(f"{tmp_path}/o").collect()) == [(1, True, False), (2, True, False), (3, None, True), (4, True, False)]
