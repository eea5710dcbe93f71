"""Windows over tiled grids and over the year, and pairs by time, against brute force."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import climatology, grids, periods


def test_windows_of_many_tiles(spark):
    """All windows of a grid of uneven tiles, one tile missing, one there twice, cells null; and windows that leave the grid."""
    rng = np.random.default_rng(4)
    h, w, down, across = 3, 4, 3, 2
    grid = rng.integers(0, 9, (down * h, across * w)).astype(float)
    grid[3:6, 4:8] = 0
    rows = [(1, ty, tx, [float(v) for v in grid[ty * h : ty * h + h, tx * w : tx * w + w].ravel()]) for ty in range(down) for tx in range(across) if (ty, tx) != (1, 1)]
    rows.append((1, 0, 1, [1.0] * 11 + [None]))
    grid[0:3, 4:8] += np.array([1.0] * 11 + [0]).reshape(3, 4)
    rows.append((2, 0, 0, None))
    sums = grids.summed(spark.createDataFrame(rows, "grid int, ty int, tx int, cells array<double>"), h, w)
    windows = [(y, x, a, b) for y in range(-1, 10) for x in range(-1, 9) for a in (1, 2, 5, 12) for b in (1, 3, 9)]
    samples = spark.createDataFrame([(i, 1, *win) for i, win in enumerate(windows)] + [(-1, 2, 0, 0, 2, 2), (-2, 9, 0, 0, 2, 2)], "i int, grid int, y int, x int, h int, w int")
    got = {r.i: r.total for r in grids.window_sums(samples, sums, h, w, "i").collect()}
    assert len(got) == len(windows) + 2 and got[-1] == got[-2] == 0
    for i, (y, x, a, b) in enumerate(windows):
        assert got[i] == grid[max(0, y) : max(0, y + a), max(0, x) : max(0, x + b)].sum(), windows[i]
    with pytest.raises(Exception, match="3 by 4"):
        grids.summed(spark.createDataFrame([(1, 0, 0, [1.0])], "grid int, ty int, tx int, cells array<double>"), h, w).collect()
    assert grids.window_sums(samples, sums.limit(0), h, w, "i").agg(F.sum("total")).first()[0] == 0


@pytest.mark.parametrize("days", [0, 3, 182])
def test_climatology_wraps(spark, days):
    rng = random.Random(days)
    rows = [(rng.choice(["a", None]), datetime(2019, 1, 1) + timedelta(days=rng.choice([0, 1, 58, 59, 60, 364, 365, 424, 789]) + 365 * rng.randint(0, 4), hours=rng.choice([0, 6])), rng.choice([None, 1.25, -3.5, 10.0])) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, v double")
    day = lambda t: (t.replace(year=2024) - datetime(2024, 1, 1)).days + 1
    got = climatology.climatology(df, ["k"], "t", "v", days).collect()
    groups = {(k, t.hour) for k, t, _ in rows}
    assert len(got) == 366 * len(groups)
    for r in got:
        near = [v for k, t, v in rows if (k, t.hour) == (r.k, r.hour) and v is not None and min(abs(day(t) - r.day), 366 - abs(day(t) - r.day)) <= days]
        assert r["count"] == len(near) and (r.mean is None if not near else abs(r.mean - sum(near) / len(near)) < 1e-12)
    means = climatology.climatology(df, ["k"], "t", "v", days)
    assert climatology.anomalies(df, means, ["k"], "t", "v").count() == len(rows)


def test_pairs_with_all_rows_in_one_hour(spark):
    """Times within one hour, many of them equal, are dealt to many tasks; null times have no pair."""
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rng = random.Random(2)
    coarse = [(at(rng.randint(0, 3600)), k) for k in range(300)]
    fine = [(i, at(rng.choice([1800, rng.randint(0, 3600)]))) for i in range(3000)] + [(-1, None), (-2, at(90000))]
    out = periods.pair_as_of(spark.createDataFrame(fine, "i int, t timestamp_ntz"), spark.createDataFrame(coarse, "c timestamp_ntz, k int"), "t", "c", "k", 60)
    got = {r.i: (r.k, r.paired_c) for r in out.collect()}
    best = {}
    for c, k in coarse:
        best[c] = max(k, best.get(c, -1))
    for i, t in fine:
        before = [c for c in best if t is not None and c <= t and (t - c).total_seconds() <= 60]
        assert got[i] == ((best[max(before)], max(before)) if before else (None, None))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_unequal_lengths_are_refused(spark):
    from skyloom.operators import series

    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "s string, t int")
    assert tuple(series.common_length(df, "s").first()) == (2, False)
    with pytest.raises(Exception, match="unequal"):
        series.common_length(df, "s", refuse=True).collect()
    assert tuple(series.common_length(df.where("t = 1"), "s", refuse=True).first()) == (1, True)
    assert tuple(series.common_length(df.limit(0), "s", refuse=True).first()) == (0, True)


def test_spread_folds_equal_plain_ones(spark):
    """A hot key, ties, null keys and values: folds over ranges with carries give what one task a key gives, and in several tasks."""
    from skyloom.operators import metrics, series

    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.choice([None, float(rng.randint(0, 50))]), float(rng.randint(0, 900))) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, i int, v double, s double")
    folds = {
        "minimum": lambda spread: metrics.running_minimum(df, "k", ["i"], "v", spread=spread),
        "order": lambda spread: series.order_violations(df, "k", ["i"], "v", spread=spread),
        "eta": lambda spread: metrics.remaining_time(df, "k", ["i"], "s", 700, spread=spread),
    }
    for name, fold in folds.items():
        plain, spread = fold(False), fold(True)
        assert sorted(plain.columns) == sorted(spread.columns), name
        key = lambda d: sorted((tuple(r) for r in d.select(sorted(plain.columns)).collect()), key=repr)
        assert key(plain) == key(spread), name
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert metrics.running_minimum(df.where("k = 'hot'"), "k", ["i"], "v", spread=True).select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
